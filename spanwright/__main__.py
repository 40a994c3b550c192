"""Command line: python -m spanwright COMMAND, on the session that spark-submit or the local machine provides."""

from __future__ import annotations

import argparse
import functools

from pyspark.sql import SparkSession

from . import annotators
from . import schemas as S
from .plans import pipelines
from .sources import annotation, readers, sinks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanwright")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("stories", help="tokens, reading times and a parse into one record per story")
    a.add_argument("--repo", help="corpus folder; its default files are used where no path is given")
    for name in ("--tok", "--wordinfo", "--ud-conll"):
        a.add_argument(name)
    a.add_argument("--out", required=True)
    a = sub.add_parser("items", help="annotate (context, target) items")
    b = sub.add_parser("sentences", help="annotate stories, one record per sentence")
    for x in (a, b):
        x.add_argument("--in", dest="source", required=True)
        x.add_argument("--out", required=True)
        x.add_argument("--coref", default="rules", help="annotator: rules, none, fastcoref, coreferee, maverick")
        x.add_argument("--device")
        x.add_argument("--coref-model")
        x.add_argument("--spacy-sm", action="store_true")
    a.add_argument("--turn-sep")
    a.add_argument("--annotate-alternatives", action="store_true")
    b.add_argument("--coref-max-words", type=int)
    b.add_argument("--coref-overlap-sents", type=int, default=3)
    b.add_argument("--context-window", type=int)
    b.add_argument("--per-subject-rts")
    a = sub.add_parser("surprisal", help="surprisal of every word of a token file behind its context")
    a.add_argument("--tok", required=True)
    a.add_argument("--model-name-or-path", default="openai-community/gpt2", help="a language model, or counts:PATH of a word and count table")
    a.add_argument("--window-size", type=int, default=128)
    a.add_argument("--stride", type=int, default=1)
    a.add_argument("--batch-size", type=int, default=16)
    a.add_argument("--device", default="cpu")
    a.add_argument("--out-file", required=True)
    a = sub.add_parser("audit", help="one page of chains from sentence records")
    a.add_argument("--in", dest="source", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--page-per-story", action="store_true")
    a = sub.add_parser("templates", help="annotation templates from a parse")
    a.add_argument("--ud-conll", required=True)
    a.add_argument("--out", required=True)
    return p


def corpus_paths(repo: str | None, tok: str | None, wordinfo: str | None, parse: str | None) -> tuple[str, str, str]:
    """Given paths, or their places in a corpus folder; an error if one is missing."""
    defaults = ("naturalstories_RTS/all_stories.tok", "naturalstories_RTS/processed_wordinfo.tsv", "parses/ud/stories-aligned.conllx")
    found = [given or (f"{repo.rstrip('/')}/{d}" if repo else None) for given, d in zip((tok, wordinfo, parse), defaults, strict=True)]
    if None in found:
        raise SystemExit("give --repo, or all of --tok, --wordinfo and --ud-conll")
    return found[0], found[1], found[2]


def _factory(args: argparse.Namespace):
    if args.coref in ("fastcoref", "coreferee", "maverick"):
        from .annotators import models  # noqa: F401  registers them
    options = {"device": args.device, "model": args.coref_model, "small_first": args.spacy_sm or None}
    return functools.partial(annotators.build, args.coref, **{k: v for k, v in options.items() if v is not None})


def _scorer(spark: SparkSession, name: str, device: str):
    from .annotators.scorers import CountScorer, LanguageModel

    if not name.startswith("counts:"):
        return functools.partial(LanguageModel, name, device)
    counts = spark.read.schema("word string, n double").option("sep", "\t").option("quote", "").csv(name.removeprefix("counts:"))
    table = {r["word"]: r["n"] for r in counts.where("word IS NOT NULL").groupBy("word").agg({"n": "sum"}).toDF("word", "n").collect()}  # a vocabulary
    return functools.partial(CountScorer, table)


def _report(out, path: str, **metrics) -> None:
    """Write JSON lines, and print what was written."""
    print(sinks.counted(out, lambda df: sinks.write_jsonl(df, path), **metrics))


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("spanwright").getOrCreate()
    if args.command == "stories":
        tok, info, parse = corpus_paths(args.repo, args.tok, args.wordinfo, args.ud_conll)
        out = pipelines.build_stories(readers.read_tokens(spark, tok), readers.read_rt_stats(spark, info), readers.read_conllx(spark, parse))
        _report(out, args.out)
    elif args.command == "items":
        items = readers.read_jsonl(spark, args.source, S.ITEM)
        annotate = pipelines.annotate_with_alternatives if args.annotate_alternatives else pipelines.annotate_items
        out = annotate(items, _factory(args), args.turn_sep)
        _report(out, args.out)
    elif args.command == "sentences":
        subjects = readers.read_subject_rts(spark, args.per_subject_rts) if args.per_subject_rts else None
        stories = readers.read_jsonl(spark, args.source, S.STORY)
        out = pipelines.annotate_stories(stories, _factory(args), args.context_window, subjects, args.coref_max_words, args.coref_overlap_sents)
        _report(out, args.out, mentions=pipelines.F.sum(pipelines.F.coalesce(pipelines.F.size("target_mentions"), pipelines.F.lit(0))))
    elif args.command == "surprisal":
        scored = pipelines.score_stories(readers.read_tokens(spark, args.tok), _scorer(spark, args.model_name_or_path, args.device), args.window_size, args.stride, args.batch_size)
        sinks.write_surprisal(scored, args.out_file)
    elif args.command == "audit":
        stories = pipelines.audit_stories(readers.read_jsonl(spark, args.source, S.SENTENCE_RECORD))
        if args.page_per_story:
            sinks.write_pages(stories, args.out)
        else:
            print(sinks.write_page(stories, args.out), "stories")
    else:
        annotation.write_templates(annotation.annotation_template(readers.read_conllx(spark, args.ud_conll)), args.out)


if __name__ == "__main__":
    main()
