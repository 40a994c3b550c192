"""Shrinkage and posteriors of sites against a plain version."""

import math
import random

import pytest

from spanwright.llm import common, site_quality

KEPT = "doc_id long, evidence double, __site string, __path string"


def plain(rows):
    """The rates of host and path, and that of the path without the document, by loops over the rows."""
    logit = 0.0
    for _ in range(site_quality.EM_STEPS):
        rate = min(max(sum(1 / (1 + math.exp(-e - logit)) for _, e, _, _ in rows) / len(rows), 1e-4), 1 - 1e-4)
        logit = math.log(rate / (1 - rate))
    soft = {i: 1 / (1 + math.exp(-e - logit)) for i, e, _, _ in rows}
    corpus = sum(soft.values()) / len(rows)

    def sums(key):
        out = {}
        for r in rows:
            good, n = out.get(key(r), (0.0, 0))
            out[key(r)] = (good + soft[r[0]], n + 1)
        return out

    def strength(groups, parent):
        within = sum(n * parent(k) * (1 - parent(k)) for k, (_, n) in groups.items())
        around = sum(n * (g / n - parent(k)) ** 2 for k, (g, n) in groups.items())
        chance = sum(parent(k) * (1 - parent(k)) for k in groups)
        total = sum(n for _, n in groups.values())
        return min(max(within / total / max((around - chance) / total, 1e-12) - 1, site_quality.MIN_STRENGTH), site_quality.MAX_STRENGTH)

    hosts, paths = sums(lambda r: r[2]), sums(lambda r: (r[2], r[3]))
    k1 = strength(hosts, lambda h: corpus)
    host_rate = {h: (g + k1 * corpus) / (n + k1) for h, (g, n) in hosts.items()}
    k2 = strength(paths, lambda p: host_rate[p[0]])
    out = {}
    for i, _, h, p in rows:
        (hg, hn), (pg, pn) = hosts[h], paths[h, p]
        above = (hg - soft[i] + k1 * corpus) / (hn - 1 + k1)
        out[i] = (host_rate[h], (pg + k2 * host_rate[h]) / (pn + k2), (pg - soft[i] + k2 * above) / (pn - 1 + k2))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rates_equal_a_plain_version(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.gauss(0.5 if h < 4 else -2, 2), f"h{h}", f"p{rng.randrange(3)}") for i in range(400) for h in [min(int(rng.expovariate(0.5)), 9)]]
    rows.append((1000, -3.0, "lone", "p"))
    scored = common.materialize(spark.createDataFrame(rows, KEPT), "scored")
    rates, without = site_quality.site_rates(scored, "__site", "__path")
    got = scored.join(rates, ["__site", "__path"]).withColumn("prior_rate", without(scored["evidence"])).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["host_rate"], r["site_rate"], r["prior_rate"]) == pytest.approx(want[r["doc_id"]], rel=1e-9)
    lone = next(r for r in got if r["doc_id"] == 1000)
    corpus = sum(w[2] for w in want.values()) / len(want)
    assert abs(lone["prior_rate"] - corpus) < 0.1  # without itself, its site tells nothing
