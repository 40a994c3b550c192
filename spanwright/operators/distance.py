"""How far a sentence departs from alternatives, by the entities that they mention.

`targets` below hold one row per mention of a compared sentence: the keys of the comparison
(`keys`), k (0: the sentence itself, 1...: alternatives), cluster, givenness (given or new,
relative to the context before the sentence), form, role, etype. A sentence without mentions
still counts: `sides` lists every (keys, k).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of roles, in features and in the graph (fixed values).
ROLE_WEIGHTS = {"subject": 3.0, "object": 2.0, "oblique": 1.0, "possessive": 1.0, "other": 0.5}
GRAPH_WEIGHTS = {"subject": 3.0, "object": 2.0}
#: Mentions of the shorter side up to which sets of them are listed; numbers held at once where many matrices are solved.
SMALL, CELLS = 8, 1 << 20
#: Transition classes, in the order in which they are tried (fixed values).
TRANSITIONS = (
    "old_object_becomes_subject",
    "old_subject_continues",
    "given_pronoun_subject",
    "given_definite_subject",
    "accessible_definite_np",
    "new_person_introduced",
    "only_new_entities",
    "previous_subject_dropped",
    "other",
)
FEATURES = {
    "full": ("cluster", "givenness", "form", "role"),
    "recurrence": ("cluster",),
    "role_form": ("role", "form", "cluster"),
    "role_form_no_other": ("role", "form", "cluster"),
    "role_only": ("role", "cluster"),
}
#: Features that let a mention match in part: its entity, with its form, with its role, and whole.
BACKOFF = (("cluster",), ("cluster", "form"), ("cluster", "role"), FEATURES["full"])


def role_class(dep: Column) -> Column:
    """One of five roles of a dependency label."""
    return (
        F.when(dep.isin("nsubj", "nsubjpass", "nsubj:pass", "csubj", "csubjpass"), "subject")
        .when(dep.isin("dobj", "iobj", "obj"), "object")
        .when(dep.isin("nmod:poss", "poss"), "possessive")
        .when(dep.isin("nmod", "obl", "pobj") | F.startswith(dep, F.lit("nmod:")) | F.startswith(dep, F.lit("obl:")), "oblique")
        .otherwise("other")
    )


def form_class(tag: Column, first_word: Column) -> Column:
    """How a mention refers, by the tag of its head and its first word."""
    word = F.lower(first_word)
    return (
        F.when(tag.isin("PRP", "PRP$"), "pronoun")
        .when(tag.isin("NNP", "NNPS"), "proper_name")
        .when(word.isin("a", "an"), "indefinite_np")
        .when(word.isin("the", "this", "that", "these", "those", "my", "your", "his", "her", "its", "our", "their"), "definite_np")
        .otherwise("bare_np")
    )


def weight_of(role: Column, weights: dict[str, float], other: float) -> Column:
    w = F.lit(other)
    for name, value in weights.items():
        w = F.when(role == name, F.lit(value)).otherwise(w)
    return w


def _with_gold(rows: DataFrame, keys: list[str], feature: list[str], value: str) -> DataFrame:
    """`rows` (keys, k, feature, value) with g, the sentence's own value of each feature.

    By a window, so that rows dealt by their keys stay where they are, and the sentence's own features
    are not repeated for every alternative: those that an alternative lacks follow from their sum.
    """
    own = F.max(F.when(F.col("k") == 0, F.col(value))).over(Window.partitionBy(*keys, *feature))
    return rows.withColumn("g", F.coalesce(own, F.lit(0.0)))


def _compared(facts: DataFrame, sides: DataFrame, keys: list[str], distance) -> DataFrame:
    """(keys, k, distance) of every alternative; `facts`: a row of (keys, k, ...) for each side with mentions.

    distance(own, other) gets the facts of the sentence and of the alternative, null without any; they meet
    the sides by one row for each sentence.
    """
    listed = facts.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in facts.columns if c not in keys])).alias("__facts"))
    own = sides.where("k > 0").select(*keys, "k").join(listed, keys, "left")
    at = lambda k: F.get(F.filter("__facts", lambda x: x["k"] == k), F.lit(0))
    own = own.withColumns({"__own": at(F.lit(0)), "__other": at(F.col("k"))})
    return own.select(*keys, "k", distance(F.col("__own"), F.col("__other")).alias("distance"))


def entity_set(targets: DataFrame, sides: DataFrame, keys: list[str]) -> DataFrame:
    """1 - Jaccard similarity of the sets of old entities."""
    old = targets.where("givenness = 'given'").select(*keys, "k", "cluster").distinct().withColumn("one", F.lit(1.0))
    facts = _with_gold(old, keys, ["cluster"], "one").groupBy(*keys, "k").agg(F.sum("one").alias("n"), F.sum("g").alias("common"))

    def distance(own: Column, other: Column) -> Column:
        common, n = F.coalesce(other["common"], F.lit(0.0)), F.coalesce(own["n"], F.lit(0.0)) + F.coalesce(other["n"], F.lit(0.0))
        return F.when(n > 0, 1 - common / (n - common)).otherwise(F.lit(0.0))

    return _compared(facts, sides, keys, distance)


def feature_vectors(targets: DataFrame, keys: list[str], features: str = "full", weighted: bool = False) -> DataFrame:
    """(keys, k, feature, value): counts of composite features, by role weight if asked for; "backoff" counts each mention in four ways."""
    rows = targets.where("role <> 'other'") if features.endswith("no_other") else targets
    entity = F.when(F.col("givenness") == "new", F.concat(F.lit("NEW-"), F.coalesce("etype", F.lit("other")))).otherwise(F.col("cluster").cast("string"))
    joined = lambda names, *mark: F.concat_ws("|", *mark, *[entity if c == "cluster" else F.col(c) for c in names])
    feature = F.explode(F.array(*[joined(names, F.lit(str(n))) for n, names in enumerate(BACKOFF)])) if features == "backoff" else joined(FEATURES[features])
    weight = weight_of(F.col("role"), ROLE_WEIGHTS, ROLE_WEIGHTS["other"]) if weighted else F.lit(1.0)
    return rows.select(*keys, "k", weight.alias("weight"), feature.alias("feature")).groupBy(*keys, "k", "feature").agg(F.sum("weight").alias("value"))


def _feature_distance(vectors: DataFrame, sides: DataFrame, keys: list[str], part, alone: float, last) -> DataFrame:
    """last(sum of part(g, a) over all features) of the normalised vectors; 1 if one side is empty, 0 if both are.

    A feature that only the sentence has adds `alone` times its share.
    """
    total = F.sum("value").over(Window.partitionBy(*keys, "k"))
    shares = vectors.withColumn("a", F.col("value") / total).drop("value")
    both = _with_gold(shares, keys, ["feature"], "a")
    facts = both.groupBy(*keys, "k").agg(F.sum(part(F.col("g"), F.col("a"))).alias("met"), F.sum("g").alias("shared"), F.sum("a").alias("all"))

    def distance(own: Column, other: Column) -> Column:
        found = last(other["met"] + alone * F.greatest(own["all"] - other["shared"], F.lit(0.0)))
        empty = lambda side: side.isNull() | (side["all"] == 0)
        return F.when(own.isNull() & other.isNull(), F.lit(0.0)).when(empty(own) | empty(other), F.lit(1.0)).otherwise(found)

    return _compared(facts, sides, keys, distance)


def feature_l1(vectors: DataFrame, sides: DataFrame, keys: list[str]) -> DataFrame:
    """Half the L1 distance of the normalised vectors; 1 if one side is empty, 0 if both are."""
    return _feature_distance(vectors, sides, keys, lambda g, a: F.abs(g - a), 1.0, lambda x: x / 2)


def feature_js(vectors: DataFrame, sides: DataFrame, keys: list[str]) -> DataFrame:
    """Square root of the Jensen-Shannon divergence (base 2); 1 if one side is empty, 0 if both are."""
    part = lambda x, middle: F.when(x > 0, x * F.log2(x / middle)).otherwise(F.lit(0.0))
    return _feature_distance(vectors, sides, keys, lambda g, a: part(g, (g + a) / 2) + part(a, (g + a) / 2), 1.0, lambda x: F.sqrt(F.greatest(x / 2, F.lit(0.0))))


def new_entities(targets: DataFrame, sides: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of the numbers of new entities."""
    new = targets.where("givenness = 'new' AND cluster IS NOT NULL").select(*keys, "k", "cluster").distinct()
    facts = new.groupBy(*keys, "k").agg(F.count("*").cast("double").alias("n"))
    return _compared(facts, sides, keys, lambda own, other: F.abs(F.coalesce(own["n"], F.lit(0.0)) - F.coalesce(other["n"], F.lit(0.0))))


def transition_class(targets: DataFrame, sides: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, transition) of every side; `before`: (keys, cluster, role) of the sentence before it."""
    prior = before.groupBy(*keys, "cluster").agg(F.max((F.col("role") == "subject").cast("int")).alias("was_subject"), F.max((F.col("role") == "object").cast("int")).alias("was_object"))
    own = targets.join(prior, [*keys, "cluster"], "left")
    subject, given = F.col("role") == "subject", F.col("givenness") == "given"
    has = lambda c: F.max(F.coalesce(c, F.lit(False)))
    flags = own.groupBy(*keys, "k").agg(
        has(subject & (F.col("was_object") == 1) & (F.col("was_subject") == 0)).alias("object_rises"),
        has(subject & (F.col("was_subject") == 1)).alias("subject_stays"),
        has(subject & given & (F.col("form") == "pronoun")).alias("given_pronoun"),
        has(subject & given & (F.col("form") == "definite_np")).alias("given_definite"),
        has(~subject & given & (F.col("form") == "definite_np")).alias("accessible"),
        has(~given & (F.col("etype") == "person")).alias("new_person"),
        has(~given).alias("any_new"),
        has(given).alias("any_given"),
    )
    subjects = before.where("role = 'subject'").select(*keys).distinct().withColumn("had_subject", F.lit(True))
    rows = sides.select(*keys, "k").join(flags, [*keys, "k"], "left").join(subjects, keys, "left")
    tests = ("object_rises", "subject_stays", "given_pronoun", "given_definite", "accessible", "new_person")
    out = F.lit(None).cast("string")
    for test, name in reversed(list(zip(tests, TRANSITIONS, strict=False))):
        out = F.when(F.col(test), name).otherwise(out)
    rest = F.when(F.col("any_new") & ~F.col("any_given"), "only_new_entities").when(F.col("had_subject"), "previous_subject_dropped").otherwise("other")
    return rows.select(*keys, "k", F.coalesce(out, rest).alias("transition"))


def transition_surprisal(classes: DataFrame, keys: list[str], alpha: float = 1.0) -> DataFrame:
    """-ln of the smoothed share of alternatives with the sentence's own transition class."""
    gold = classes.where("k = 0").select(*keys, F.col("transition").alias("own"))
    alternatives = classes.where("k > 0").join(gold, keys)
    counts = alternatives.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("transition") == F.col("own")).cast("int")).alias("same"))
    return counts.select(*keys, "n", "same", (-F.log((F.col("same") + alpha) / (F.col("n") + alpha * len(TRANSITIONS)))).alias("surprisal"))


def graph_distance(targets: DataFrame, sides: DataFrame, context: DataFrame, keys: list[str], epsilon: float = 1e-9, scope: list[str] | None = None, at: str | None = None) -> DataFrame:
    """Distance of the connections to earlier sentences; `context`: (keys, past, cluster, role) of the sentences before.

    With `scope` (the keys of a document) and `at` (the key that numbers its sentences), `context` is
    (scope, past, cluster, role) of all sentences, of which those before `at` count: no sentence's
    mentions are repeated for every later one.
    """
    edge = lambda df, *by: df.groupBy(*by, "cluster").agg(F.max(weight_of(F.col("role"), GRAPH_WEIGHTS, 1.0)).alias("w"))
    own = scope or keys
    linked = edge(targets, *keys, "k").join(edge(context, *own, "past").withColumnRenamed("w", "c"), [*own, "cluster"])
    linked = linked.where(F.col("past") < F.col(at)) if at else linked
    # Links of a sentence are found in the tasks of their clusters, so summing before the shuffle would add few.
    linked = linked.select(*keys, "k", "past", "w", "c").repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    profile = linked.groupBy(*keys, "k", "past").agg(F.sum(F.col("w") * F.col("c")).alias("value"))
    both = _with_gold(profile, keys, ["past"], "value")
    facts = both.groupBy(*keys, "k").agg(F.sum(F.abs(F.col("g") - F.col("value"))).alias("met"), F.sum("g").alias("shared"), F.sum("value").alias("all"))

    def distance(own: Column, other: Column) -> Column:
        of = lambda side, c: F.coalesce(side[c], F.lit(0.0))
        return (of(other, "met") + of(own, "all") - of(other, "shared")) / (of(own, "all") + of(other, "all") + epsilon)

    return _compared(facts, sides, keys, distance)


def aggregate_alternatives(distances: DataFrame, keys: list[str], name: str = "distance") -> DataFrame:
    """Mean and 80th percentile over the alternatives."""
    return distances.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(name).alias("mean"), F.percentile(name, F.lit(0.8)).alias("p80"))


def combined(parts: dict[str, tuple[DataFrame, float]], keys: list[str]) -> DataFrame:
    """Weighted sum of several distances, each kept beside it."""
    out, total = None, F.lit(0.0)
    for name, (df, weight) in parts.items():
        own = df.select(*keys, "k", F.col("distance").alias(name))
        out = own if out is None else out.join(own, [*keys, "k"])
        total = total + weight * F.col(name)
    return out.withColumn("distance", total)


def pair_cost(weights: dict[str, float] | None = None) -> Column:
    """Cost of matching mentions a_* and b_*: weighted mismatches of cluster, givenness, form, role and text."""
    weights = weights or dict.fromkeys(("cluster", "givenness", "form", "role", "text"), 0.2)
    cost = F.lit(0.0)
    for name, w in weights.items():
        cost = cost + w * F.coalesce((F.col(f"a_{name}") != F.col(f"b_{name}")).cast("int"), F.lit(1))
    return cost


def assignment(cost: np.ndarray) -> float:
    """Least total cost of matching every row to a column of its own (no more rows than columns), by shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    rows = cost.tolist()
    for i in range(1, n + 1):
        match[0], column = i, 0
        least, way, seen, free = [float("inf")] * (m + 1), [0] * (m + 1), [0], list(range(1, m + 1))
        while match[column]:
            own, shift = rows[match[column] - 1], u[match[column]]
            nearest, delta = 0, float("inf")
            for j in free:
                reduced = own[j - 1] - shift - v[j]
                if reduced < least[j]:
                    least[j], way[j] = reduced, column
                if least[j] < delta:
                    nearest, delta = j, least[j]
            for j in seen:
                u[match[j]] += delta
                v[j] -= delta
            for j in free:
                least[j] -= delta
            column = nearest
            seen.append(column)
            free.remove(column)
        while column:
            match[column] = match[way[column]]
            column = way[column]
    return float(sum(rows[match[j] - 1][j - 1] for j in range(1, m + 1) if match[j]))


def transport(costs: np.ndarray, gap: float = 1.0) -> float:
    """Unbalanced transport of n mentions to m, each matched once or paid `gap` for, divided by max(n, m).

    A match saves two gaps; one that costs more than these is none. So every mention of the shorter side is matched.
    """
    n, m = costs.shape
    if not n or not m:
        return float(max(n, m) > 0) * gap
    saved = np.minimum(costs if n <= m else costs.T, 2 * gap)
    return (assignment(saved) + gap * abs(n - m)) / max(n, m)


def assignments(costs: np.ndarray) -> np.ndarray:
    """`assignment` of many matrices of one shape (no more rows than columns): the best cost of every set of rows, column by
    column, for up to SMALL rows; matrices with more are solved one by one."""
    size, n, m = costs.shape
    if n > SMALL:
        return np.array([assignment(c) for c in costs])
    sets = np.arange(1 << n)
    best = np.full((1 << n, size), np.inf)
    best[0] = 0
    for j in range(m):
        last = best.copy()
        for i in range(n):
            having = sets[sets >> i & 1 == 1]
            best[having] = np.minimum(best[having], last[having ^ (1 << i)] + costs[:, i, j])
    return best[-1]


def transports(costs: np.ndarray, gap: float = 1.0) -> np.ndarray:
    """`transport` of many matrices of one shape."""
    size, n, m = costs.shape
    if not n or not m:
        return np.full(size, float(max(n, m) > 0) * gap)
    saved = np.minimum(costs if n <= m else costs.transpose(0, 2, 1), 2 * gap)
    return (assignments(saved) + gap * abs(n - m)) / max(n, m)


def transport_distance(targets: DataFrame, sides: DataFrame, keys: list[str], weights: dict[str, float] | None = None, gap: float = 1.0) -> DataFrame:
    """Transport distance of mentions. Both sides of a comparison meet in one row, which is solved in Arrow batches."""
    weights = weights or dict.fromkeys(("cluster", "givenness", "form", "role", "text"), 0.2)
    mention = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in weights])
    facts = targets.groupBy(*keys, "k").agg(F.collect_list(mention).alias("m"))
    w = [float(x) for x in weights.values()]

    @F.arrow_udf("double")
    def solved(ours: pa.Array, theirs: pa.Array) -> pa.Array:
        sides = [x.cast(pa.list_(pa.list_(pa.string()))) for x in (ours, theirs)]
        sizes = np.array([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in sides], int)
        words = pa.concat_arrays([x.flatten().flatten() for x in sides]).dictionary_encode().indices.to_numpy()
        mentions = words.reshape(-1, len(w))
        first = np.cumsum(sizes, axis=1) - sizes
        first[1] += sizes[0].sum()
        out = np.empty(len(ours))
        shapes, shape = np.unique(sizes.T, axis=0, return_inverse=True)
        for s, (n, m) in enumerate(shapes):
            like = np.flatnonzero(shape.ravel() == s)
            step = max(1, CELLS // max(1, n * m, m << min(n, m, SMALL)))
            for at in (like[i : i + step] for i in range(0, len(like), step)):
                a, b = (mentions[first[k][at][:, None] + np.arange(size)] for k, size in ((0, n), (1, m)))
                costs = sum(x * (a[:, :, None, f] != b[:, None, :, f]) for f, x in enumerate(w))
                out[at] = transports(costs.astype(float), gap)
        return pa.array(out)

    return _compared(facts, sides, keys, lambda own, other: solved(own["m"], other["m"]))
