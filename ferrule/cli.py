"""Command line: index, search, topics, status, bench.  Words that are no command are a search.

An index keeps the configuration it was built with: roots with profiles, ignore rules, model, floor.
`index` without roots scans the known ones that are due; `search` uses the kept floor and model.
"""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import asdict

COMMANDS = ("search", "init", "index", "status", "topics", "model", "config", "bench")


def with_implicit_search(argv: list[str]) -> list[str]:
    return argv if not argv or argv[0] in COMMANDS or argv[0] in ("-h", "--help") else ["search", *argv]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ferrule")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="search an index")
    s.add_argument("words", nargs="*")
    s.add_argument("--limit", type=int)
    s.add_argument("--mode", choices=("hybrid", "lexical", "dense"), default="hybrid")
    s.add_argument("--topic", type=int)
    s.add_argument("--floor", type=float, help="least cosine; the configuration's or the model's by default")
    s.add_argument("--rerank")
    s.add_argument("--scores", action="store_true")
    s.add_argument("--save")
    i = sub.add_parser("init", help="look at folders, suggest profiles, write a configuration")
    i.add_argument("roots", nargs="*", help="the usual folders of a home by default")
    i.add_argument("--rate", type=float, default=100.0)
    i.add_argument("--config")
    i = sub.add_parser("index", help="scan folders; known ones that are due by default")
    i.add_argument("roots", nargs="*")
    i.add_argument("--config")
    i.add_argument("--model")
    i.add_argument("--no-embed", action="store_true")
    i.add_argument("--force", action="store_true")
    t = sub.add_parser("status", help="what an index holds")
    t.add_argument("--verify", action="store_true")
    t = sub.add_parser("topics", help="build, list or show topics")
    t.add_argument("action", choices=("build", "list", "show"))
    t.add_argument("topic", nargs="?", type=int)
    t.add_argument("--k", type=int)
    t.add_argument("--limit", type=int, default=40)
    sub.add_parser("model", help="list models")
    c = sub.add_parser("config", help="print a configuration file, or the index's own")
    c.add_argument("path", nargs="?")
    b = sub.add_parser("bench", help="time searches over an index, with their recall, and its model")
    b.add_argument("--golden", help="lines of: query, tab, part of a path that an answer has")
    b.add_argument("--repeat", type=int, default=3)
    for name in COMMANDS:
        if name != "model":
            sub.choices[name].add_argument("--index", default=".ferrule")
    return p


#: Folders of a home that `init` looks at when it is given none.
USUAL_FOLDERS = ("Documents", "Desktop", "Downloads", "Pictures", "projects", "src")


def candidate_roots(home: str) -> list[str]:
    return [p for p in (os.path.join(home, n) for n in USUAL_FOLDERS) if os.path.isdir(p)] or [home]


def listing(spark, c, roots: list):
    """Extracted files of all roots, each by its profile, and the number of unreadable entries."""
    from functools import reduce

    from .operators import geo
    from .sources import walk

    places = geo.read_places(spark, c.places) if c.media and c.places else None
    parts, skipped = [], 0
    for root in roots:
        seen = walk.survey(root.path)
        skipped += len(seen.unreadable)
        files = walk.list_files(spark, root.path, c.max_file_mb, symlinks=c.symlinks, seen=seen, extra=tuple(c.extra_ignores), unignore=tuple(c.unignore), hidden=c.hidden)
        inner = [o.path for o in c.roots if o.path != root.path and o.path.startswith(root.path.rstrip("/") + "/")]
        if inner:  # a nested root is listed by itself, with its own profile
            from .sources.corpus import under

            files = files.where(~under(files["path"], inner))
        parts.append(walk.extract(files, root.profile, c.media, places=places, max_read_kb=c.max_read_kb))
    return reduce(lambda a, b: a.unionByName(b), parts), skipped


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(with_implicit_search(sys.argv[1:] if argv is None else argv))
    import json
    import time

    from pyspark.sql import functions as F

    from . import config
    from .functions import models
    from .operators import dense, health, topics
    from .plans import ingest, search
    from .plans import topics as topic_plans
    from .session import get_session
    from .sources import store, walk

    if args.command == "model":
        print("\n".join(sorted(models.EMBEDDERS)))
        return 0
    if args.command == "config" and args.path:
        print(config.load(args.path))
        return 0
    spark = get_session()
    show = lambda df: print("\n".join(r[0] for r in df.collect()))
    say = lambda note: print(note, file=sys.stderr) if note else None
    if args.command == "init":
        roots = walk.dedupe_nested([config.expand_path(r) for r in args.roots or candidate_roots(os.path.expanduser("~"))])
        made = []
        for r in roots:
            seen = health.probe(walk.list_files(spark, r)).first()
            made.append(config.Root(r, seen.profile))
            print(f"{r}: {seen.files} files, profile {seen.profile}, about {seen.files / args.rate:.0f} s at {args.rate:g} files a second")
        if args.config:
            config.save(config.Config(made), args.config)
        return 0
    kept = store.Snapshots(spark, args.index)
    meta = kept.current()["meta"]
    c = config.from_dict(json.loads(meta["config"])) if "config" in meta else config.Config()
    if args.command == "config":
        print(c)
        return 0
    if args.command == "index":
        if args.config:
            c = config.load(args.config)
        given = [config.expand_path(r) for r in args.roots]
        known = {r.path: r for r in c.roots}
        c.roots = [*c.roots, *(config.Root(r) for r in given if r not in known)]
        c.model = args.model or c.model
        wanted = [r for r in c.roots if (r.path in given if given else args.force or ingest.due(spark, args.index, r.path, c.refresh) != "no")]
        if not wanted:
            say("nothing is due" if c.roots else "give folders to index")
            return 0 if c.roots else 1
        files, skipped = listing(spark, c, wanted)
        embedder = None if args.no_embed else models.lookup(models.EMBEDDERS, c.model)
        everything = {r.path for r in wanted} == {r.path for r in c.roots}
        done = ingest.scan(spark, args.index, files, [r.path for r in c.roots], embedder, None if everything else [r.path for r in wanted], args.force, asdict(c), skipped)
        print(done.counters)
        for gap in walk.tool_gaps():
            say(gap)
        return 0
    index = ingest.open_index(spark, args.index)
    embedder = models.lookup(models.EMBEDDERS, meta["model_id"]) if "model_id" in meta else None

    def topics_note() -> str | None:
        named = kept.read("file_topics")
        if named is None:
            return topics.stale_note(False, 0, False)
        old = topics.staleness(named, index.vectors, meta.get("topics_model_id", ""), meta.get("model_id", "")).first()
        return topics.stale_note(True, old.added, old.model_mismatch)

    def answers(text: str, mode: str, limit: int, scopes: tuple = (), topic: int | None = None, floor: float | None = None, rerank: str | None = None):
        vector = tuple(embedder.embed_query(text)) if embedder is not None and mode != "lexical" else None
        request = search.SearchRequest(text, mode, limit, c.floor() if floor is None else floor, scopes, topic, vector)
        return search.search(index, request, models.effective_reranker(rerank, c.reranker)).orderBy("position")

    if args.command == "status":
        show(health.coverage(kept.read("files")).select(F.concat_ws("\t", "extract_kind", F.col("n").cast("string"))))
        print(health.status(index.files, index.vectors, index.dirs).first().asDict())
        say(dense.dense_gap(kept.read("vectors"), index.files))
        say(topics_note())
        if args.verify and index.codes is not None:
            print(health.verify_vectors(index.files, index.codes).first().asDict())
    elif args.command == "topics":
        if args.action == "build":
            topic_plans.build_stored(spark, args.index, [r.path for r in c.roots], k=args.k)
            index, meta = ingest.open_index(spark, args.index), kept.current()["meta"]
        named = kept.read("topics")
        if named is None:
            say(topics_note())
            return 1
        if args.action == "show":
            show(topics.members(index.file_topics, index.files, args.topic, args.limit).select("path"))
        else:
            show(store.topic_lines(named.orderBy("topic")))
        say(topics_note())
    elif args.command == "bench":
        pairs = [line.rstrip("\n").split("\t") for line in open(args.golden, encoding="utf-8") if "\t" in line] if args.golden else [(r.name, r.path) for r in index.files.orderBy(F.xxhash64("id")).limit(5).collect()]
        times, hits = [], 0
        for text, expected in pairs:
            for _ in range(args.repeat):
                began = time.perf_counter()
                rows = answers(text, "hybrid", c.limit).collect()
                times.append(time.perf_counter() - began)
            hits += any(expected in r.path for r in rows)
        times.sort()
        at = lambda q: times[int((len(times) - 1) * q + 0.5)] if times else 0.0
        print(f"{len(pairs)} queries, recall {hits}/{len(pairs)}, p50 {at(0.5):.3f} s, p95 {at(0.95):.3f} s")
        if embedder is not None and pairs:
            near, far = pairs[0], pairs[-1]
            measured = models.measure(embedder, index.files, (near[0], near[1], far[1]), "body")
            print(f"{embedder.model_id}: {measured['docs_per_second']:.0f} texts/s, {measured['query_seconds'] * 1000:.1f} ms a query, margin {measured['margin']:.2f}")
    else:
        scopes, text = search.split_scope(args.words)
        if args.mode != "lexical":
            say(dense.dense_gap(kept.read("vectors"), index.files))
        if args.topic is not None:
            say(topics_note())
        found = answers(text, args.mode, args.limit or c.limit, tuple(config.expand_path(s) for s in scopes), args.topic, args.floor, args.rerank)
        lines = store.score_lines(found) if args.scores else store.plain_lines(found)
        if args.save:
            store.save_lines(lines, args.save)
        else:
            show(lines)
    return 0


if __name__ == "__main__":
    sys.exit(main())
