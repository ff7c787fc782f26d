import io
import os
import re
import subprocess
import sys
import time
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ferrule import cli, config
from ferrule.functions import models
from ferrule.operators import health, lexical
from ferrule.plans import ingest, search
from ferrule.plans import topics as topic_plans
from ferrule.sources import store, walk

#: A small library of a garden club, written for these tests.
CORPUS = {
    "club/minutes/spring.txt": "the committee voted on seed orders and the greenhouse roof",
    "club/minutes/autumn.txt": "the committee voted on compost bins and the winter talk",
    "club/members.md": "names and plots of all gardeners",
    "plants/vegetables/leek.txt": "sow leek indoors and plant it out in june",
    "plants/vegetables/kale.txt": "kale stands frost and feeds us in january",
    "plants/herbs/thyme.txt": "thyme wants sun and poor dry soil",
    "tools/irrigation/valve_control.py": "def open_valve(minutes): pump.start(minutes)",
    "tools/irrigation/__pycache__/valve_control.pyc": "compiled",
    "tools/.venv/lib/site.py": "not ours",
    "tools/irrigation/firmware.iso": "image",
    "photos/scan.dat": "\0\0\0",
}
LEFT_OUT = {n for n in CORPUS if "__pycache__" in n or ".venv" in n or n.endswith(".iso")}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for name, body in CORPUS.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return root


def files(spark, root):
    return walk.extract(walk.list_files(spark, str(root)))


def overwrite(path, text):
    """Changes a file behind Hadoop's back, its checksum included."""
    path.write_text(text)
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)


def relative(rows, root):
    return {os.path.relpath(r.path, root) for r in rows}


def test_walk_and_extract(spark, tree):
    with zipfile.ZipFile(tree / "plan.docx", "w") as z:
        z.writestr("word/document.xml", "<w:doc xmlns:w='w'><w:p><w:t>bed</w:t><w:t>north</w:t></w:p><w:p><w:t>shade</w:t></w:p></w:doc>")
    (tree / "torn.docx").write_bytes(b"no zip")
    rows = {os.path.relpath(r.path, tree): r for r in files(spark, tree).collect()}
    assert set(rows) == set(CORPUS) - LEFT_OUT | {"plan.docx", "torn.docx"}
    assert rows["plan.docx"].body == "bed north shade" and rows["plan.docx"].extract_kind == "office"
    assert (rows["torn.docx"].extract_kind, rows["photos/scan.dat"].extract_kind, rows["photos/scan.dat"].body) == ("name-only", "name-only", "")
    assert rows["club/members.md"].extract_kind == "text"
    assert health.probe(walk.list_files(spark, str(tree)).select("path")).first().source_files == 1


def test_ignore_files_links_and_unreadable_entries(spark, tree, monkeypatch):
    (tree / ".gitignore").write_text("# rules\n*.dat\n/club/minutes/*\n!/club/minutes/spring.txt\nherbs/\n")
    (tree / "plants" / ".ignore").write_text("vegetables/k*.txt\n!kale.txt\n**/leek.*\n")
    (tree / "_drafts").mkdir()
    (tree / "_drafts/note.txt").write_text("kept, whatever its folder is called")
    (tree / "shortcut").symlink_to(tree / "club")
    got = relative(walk.list_files(spark, str(tree)).collect(), tree)
    assert got == {"club/minutes/spring.txt", "club/members.md", "plants/vegetables/kale.txt", "tools/irrigation/valve_control.py", "_drafts/note.txt"}
    everything = relative(walk.list_files(spark, str(tree), ignore_files=False).collect(), tree)
    assert everything == set(CORPUS) - LEFT_OUT | {"_drafts/note.txt"}
    seen = walk.survey(str(tree))
    assert seen.links == [str(tree / "shortcut")] and seen.unreadable == []
    barred = str(tree / "club/members.md")
    monkeypatch.setattr(os, "access", lambda p, mode: str(p) != barred)
    blind = walk.survey(str(tree))
    assert blind.unreadable == [barred] and "club/members.md" not in relative(walk.list_files(spark, str(tree), seen=blind).collect(), tree)


@pytest.mark.parametrize(("rule", "hits", "misses"), [("*.log", ["a.log", "x/b.log", "x.log/y"], ["a.logs"]), ("build/", ["build/x", "a/build/y"], ["build"]), ("/top", ["top", "top/x"], ["a/top"]), ("a/b", ["a/b", "a/b/c"], ["x/a/b"]), ("d/**/z", ["d/z", "d/e/f/z"], ["e/d/z"]), ("n?te[12]", ["note1", "x/nate2"], ["note3", "nte1"])])
def test_ignore_rules(rule, hits, misses):
    pattern = re.compile(walk.rule_pattern(rule))
    assert all(pattern.search(h) for h in hits) and not any(pattern.search(m) for m in misses)


def test_pictures_get_the_name_of_their_place(spark):
    rows = spark.createDataFrame([("/p/a.jpg", "Title\n48.2\n16.4\n"), ("/p/b.jpg", "only a title"), ("/p/c.jpg", "-33.9\n151.2")], "path string, raw string")
    places = spark.createDataFrame([(48.2, 16.37, "Vienna, Austria", 0), (-33.87, 151.21, "Sydney, Australia", 1)], "lat double, lon double, place string, number long")
    assert {r.path: r.raw for r in walk.with_places(rows, places).collect()} == {"/p/a.jpg": "Title\nVienna, Austria", "/p/b.jpg": "only a title", "/p/c.jpg": "Sydney, Australia"}


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module


class Failing(models.HashingEmbedder):
    def embed_docs(self, texts):
        raise RuntimeError("no model today")


def tables(spark, index):
    store_ = store.Snapshots(spark, index)
    return {r.path: (r.hash, r.vector_hash) for r in store_.read("files").collect()}, store_.read("vectors").count() if store_.read("vectors") is not None else None


def test_an_index_follows_its_tree(spark, tree, tmp_path):
    index, root = str(tmp_path / "index"), str(tree)
    e = models.HashingEmbedder()
    scan = lambda **k: ingest.scan(spark, index, files(spark, tree), [root], e, **k).counters
    first = scan()
    n = len(CORPUS) - len(LEFT_OUT)
    assert (first["added"], first["embedded"], first["skipped"]) == (n, n, 0)
    assert scan()["unchanged"] == n
    path = tree / "plants/herbs/thyme.txt"
    os.utime(path, (5, 5))
    touched = scan()
    assert (touched["updated"], touched["embedded"]) == (1, 0)
    path.write_text("thyme likes chalk")
    assert scan()["embedded"] == 1
    path.unlink()
    gone = scan(skipped=2)
    assert (gone["deleted"], gone["seen"], gone["skipped"]) == (1, n - 1, 2)
    generation, at = ingest.root_state(spark, index, root)
    assert generation == 5 and ingest.due(spark, index, root, "daily", at + 10) == "no" and ingest.due(spark, index, root, "daily", at + 86_400) == "elapsed"
    assert ingest.due(spark, index, "/other", "manual") == "never"
    opened = ingest.open_index(spark, index, e)
    found = search.search(opened, search.SearchRequest("committee voted", query_vector=tuple(e.embed_query("committee voted")), floor=0.0))
    rows = found.orderBy("position").collect()
    assert "minutes" in rows[0].path and any(r.kind == 1 for r in rows) and all("thyme" not in r.path for r in rows)
    lexical_only = search.search(opened, search.SearchRequest("valve", mode="lexical", scopes=(f"{root}/tools",))).collect()
    assert lexical_only and all(r.path.startswith(f"{root}/tools") for r in lexical_only)
    named = topic_plans.build_stored(spark, index, [root], k=2)
    assert sum(r.files for r in named.collect()) == n - 1
    listing = search.search(ingest.open_index(spark, index), search.SearchRequest(topic=1)).collect()
    assert listing and all(r.kind == 0 for r in listing)
    assert search.search(ingest.open_index(spark, index), search.SearchRequest("")).count() == 0


def test_a_stored_index_answers_as_the_texts_do(spark, tree, tmp_path):
    index, root = str(tmp_path / "index"), str(tree)
    e = models.HashingEmbedder()
    ingest.scan(spark, index, files(spark, tree), [root], e)
    (tree / "club/members.md").write_text("plots of gardeners who voted, voted and voted")
    (tree / "plants/vegetables/kale.txt").unlink()
    ingest.scan(spark, index, files(spark, tree), [root], e)
    opened = ingest.open_index(spark, index)
    for text in ("voted committee", "plan", "gard", "kale", "nothing at all"):
        ranked = lambda df: [(r.id, r.score) for r in df.orderBy("rank").collect()]
        assert ranked(lexical.top(lexical.bm25_stored(opened.postings, opened.stats, text))) == ranked(lexical.top(lexical.bm25(opened.files, text)))
    plan = lexical.bm25_stored(opened.postings, opened.stats, "voted committee")._jdf.queryExecution().toString()
    assert "body" not in plan.replace("tf_body", "") and "StringStartsWith(term,committee)" in plan and "EqualTo(term,voted)" in plan


def test_a_scan_that_fails_leaves_the_old_index(spark, tree, tmp_path):
    index, root = str(tmp_path / "index"), str(tree)
    run = lambda e: ingest.scan(spark, index, files(spark, tree), [root], e).counters
    with pytest.raises(Exception, match="no model today"):
        run(Failing())
    assert store.Snapshots(spark, index).read("files") is None
    good = run(models.HashingEmbedder())
    n = good["added"]
    assert good["embedded"] == n and tables(spark, index)[1] == n
    (tree / "club/members.md").write_text("changed while the model is away")
    before = tables(spark, index)
    with pytest.raises(Exception, match="no model today"):
        run(Failing())
    assert tables(spark, index) == before
    again = run(models.HashingEmbedder())
    assert (again["updated"], again["embedded"]) == (1, 1) and tables(spark, index)[1] == n


def test_edit_scan_without_model_scan_with_model(spark, tree, tmp_path):
    index, root = str(tmp_path / "index"), str(tree)
    run = lambda e: ingest.scan(spark, index, files(spark, tree), [root], e).counters
    n = run(models.HashingEmbedder())["embedded"]
    edited, gone = tree / "club/members.md", tree / "plants/vegetables/leek.txt"
    edited.write_text("quite another text")
    gone.unlink()
    assert run(None)["embedded"] == 0
    state, vectors = tables(spark, index)
    assert vectors == n - 2 and state[str(edited)][1] is None  # neither stale nor deleted vectors answer
    assert run(models.HashingEmbedder())["embedded"] == 1
    state, vectors = tables(spark, index)
    assert vectors == n - 1 and all(h == v for h, v in state.values())


def test_directories_stop_at_the_roots_and_roots_are_no_answers(spark, tree, tmp_path):
    index, e = str(tmp_path / "index"), models.HashingEmbedder()
    roots = [f"{tree}/plants", f"{tree}/club", f"{tree}/plants/herbs"]
    listed = files(spark, tree).where(F.col("path").startswith(f"{tree}/plants") | F.col("path").startswith(f"{tree}/club"))
    ingest.scan(spark, index, listed, roots, e)
    opened = ingest.open_index(spark, index)
    dirs = {r.path: r.parent_path for r in opened.dirs.collect()}
    assert set(dirs) == {*roots, f"{tree}/plants/vegetables", f"{tree}/club/minutes"}
    assert dirs[f"{tree}/plants"] is None and dirs[f"{tree}/plants/herbs"] == f"{tree}/plants"
    assert set(opened.roots) == set(roots)
    for text in ("plants", "club minutes", "herbs"):
        rows = search.search(opened, search.SearchRequest(text, query_vector=tuple(e.embed_query(text)), floor=-1.0)).collect()
        assert rows and not {r.path for r in rows} & {*roots, str(tree), os.path.dirname(str(tree))}


def test_open_refuses_another_model(spark, tree, tmp_path):
    index = str(tmp_path / "index")
    ingest.scan(spark, index, files(spark, tree), [str(tree)], models.HashingEmbedder())
    with pytest.raises(ValueError, match="hashing-64"):
        ingest.open_index(spark, index, models.EMBEDDERS["hashing-128"])
    again = ingest.scan(spark, index, files(spark, tree), [str(tree)], models.EMBEDDERS["hashing-128"])
    assert again.counters["embedded"] == len(CORPUS) - len(LEFT_OUT)  # another model makes all vectors anew
    assert ingest.open_index(spark, index, models.EMBEDDERS["hashing-128"]).codes.count() == again.counters["embedded"]


def test_a_reranker_reorders_and_the_tail_follows(spark, tree, tmp_path):
    index = str(tmp_path / "index")
    e = models.HashingEmbedder()
    ingest.scan(spark, index, files(spark, tree), [str(tree)], e)
    request = search.SearchRequest("sun soil", query_vector=tuple(e.embed_query("sun soil")), floor=-1.0)
    rows = search.search(ingest.open_index(spark, index), request, models.SubstringReranker()).orderBy("position").collect()
    scores = [r.rerank for r in rows if r.kind == 0]
    assert "thyme" in rows[0].path and scores == sorted(scores, reverse=True)


def test_one_manifest_names_everything(spark, tmp_path):
    s = store.Snapshots(spark, str(tmp_path / "s"))
    assert s.read("t") is None and s.get_meta("k") is None
    s.stage("t", spark.range(3))
    s.stage("u", spark.range(4))
    assert s.read("t") is None  # nothing is seen before the commit
    s.commit({"k": "1"})
    assert (s.read("t").count(), s.read("u").count(), s.get_meta("k")) == (3, 4, "1")
    for n in range(5, 9):
        s.write("t", spark.range(n))
    assert s.read("t").count() == 8 and s.read("u").count() == 4
    kept = [p for p in (tmp_path / "s" / "t").iterdir() if p.is_dir()]
    assert len(kept) == 2 and len(list((tmp_path / "s" / "_manifests").glob("*.json"))) == 2  # this one and the one before
    s.commit(drop=("u",))
    assert s.read("u") is None
    newest = sorted((tmp_path / "s" / "_manifests").glob("*.json"))[-1]
    overwrite(newest, newest.read_text().replace('"schema": 3', '"schema": 1'))
    with pytest.raises(ValueError, match="version"):
        s.read("t")
    s.discard()
    assert s.read("t") is None


def test_locks(spark, tmp_path):
    one, two = (store.Snapshots(spark, str(tmp_path / "s")) for _ in range(2))
    with one.lock(), pytest.raises(RuntimeError, match="another scan"), two.lock():
        pass
    with one.lock(seconds=0.4):
        time.sleep(1)  # renewed while held
        with pytest.raises(RuntimeError), two.lock(seconds=0.4):
            pass
    # an owner that was killed renews no more
    code = "import os, sys; sys.path[:0] = sys.argv[2:]; open(sys.argv[1], 'w').write('a dead owner'); os.kill(os.getpid(), 9)"
    subprocess.run([sys.executable, "-c", code, str(tmp_path / "s" / "_lock")])
    with pytest.raises(RuntimeError, match="a dead owner"), one.lock():
        pass
    os.utime(tmp_path / "s" / "_lock", (1, 1))
    with one.lock():
        assert (tmp_path / "s" / "_lock").read_text() != "a dead owner"
        one.write("t", spark.range(2))
        overwrite(tmp_path / "s" / "_lock", "taken over meanwhile")
        with pytest.raises(RuntimeError, match="taken over"):
            one.write("t", spark.range(3))
    assert one.read("t").count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, "/a", 0.5, 0.25, None), (1, "/d", 0.1, None, 2.0)], "kind int, path string, score double, cosine double, rerank double")
    assert [r[0] for r in store.plain_lines(rows).collect()] == ["/a", "directory:/d"]
    assert [r[0] for r in store.score_lines(rows).collect()] == ["0.5000  cos=0.250 rr=-\t/a", "0.1000  cos=- rr=2.000\tdirectory:/d"]
    target = str(tmp_path / "out")
    store.save_lines(store.plain_lines(rows), target)
    with pytest.raises(Exception, match="exist"):
        store.save_lines(store.plain_lines(rows), target)


def test_config_round_trip(tmp_path):
    c = config.Config([config.Root("/a"), config.Root("/a/b", "code")], extra_ignores=["*.x"], refresh="weekly")
    config.save(c, str(tmp_path / "c.toml"))
    assert config.load(str(tmp_path / "c.toml")) == c
    assert (c.profile_for("/a/b/c"), c.profile_for("/a/bc"), c.profile_for("/z")) == ("code", "content", None)
    assert config.expand_path("~/x/../y", "/home/me") == "/home/me/y" and config.expand_path("a/./b", cwd="/w") == "/w/a/b"
    with pytest.raises(ValueError):
        config.Root("/a", "nothing")
    with pytest.raises(ValueError):
        config.Config(device="abacus")
    assert cli.candidate_roots("/nowhere") == ["/nowhere"]


def test_roots_rules_and_scopes():
    assert walk.dedupe_nested(["/a/b", "/a", "/ab", "/a/"]) == ["/a", "/ab"]
    assert walk.ignore_file_rules(["# c", "", "*.log", "!keep.log", "/build"]) == [("*.log", False), ("keep.log", True), ("/build", False)]
    assert search.split_scope(["/x", "leek", "/y"], lambda p: True) == (["/x"], "leek /y")
    assert [search.looks_like_path(w) for w in ("a/b", "~", "..", "leek")] == [True, True, True, False]
    with pytest.raises(ValueError):
        search.SearchRequest(topic=0)
    assert cli.with_implicit_search(["winter", "talk"]) == ["search", "winter", "talk"] and cli.with_implicit_search(["status"]) == ["status"]


def test_heads_and_xml():
    assert [walk.read_bytes(n, kb) for n, kb in ((1024, 64), (256, 64), (1024, 2), (10**6, 4096))] == [8192, 4096, 2048, 1 << 20]
    assert walk.xml_text(b"<d><p><r>one</r><r>two</r></p><p>three</p></d>") == "one two \nthree \n"
    assert walk.xml_text(b"<d><p>kept</p><broken") == "kept \n"
    assert walk.office_text(io.BytesIO(b"x").getvalue()) == ""


def test_command_line(spark, tree, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("ferrule.session.get_session", lambda *a, **k: spark)
    index, made = str(tmp_path / "index"), str(tmp_path / "c.toml")
    run = lambda *argv: (cli.main([*argv, "--index", index]), capsys.readouterr())
    assert cli.main(["init", f"{tree}/plants", f"{tree}/club", "--config", made]) == 0
    assert {r.path for r in config.load(made).roots} == {f"{tree}/plants", f"{tree}/club"}
    c = config.load(made)
    c.extra_ignores, c.min_similarity, c.limit = ["leek.txt"], -1.0, 3
    config.save(c, made)
    assert run("index", "--config", made)[0] == 0
    code, out = run("search", "committee", "voted", "--scores")
    assert code == 0 and "minutes" in out.out and out.out.count("\n") == 3  # the configuration's limit and floor
    assert "leek" not in run("leek", "--mode", "lexical")[1].out
    assert "nothing is due" in run("index")[1].err
    assert "'embedded': 5" in run("index", "--force")[1].out
    code, out = run("status", "--verify")
    assert code == 0 and "'stored': 5" in out.out and "no topics" in out.err
    assert run("topics", "build", "--k", "2")[0] == 0 and run("topics", "list")[1].out.count("\n") == 2
    golden = tmp_path / "golden.tsv"
    golden.write_text("thyme sun\tthyme\nkale frost\tkale\n")
    assert "recall 2/2" in run("bench", "--golden", str(golden), "--repeat", "1")[1].out
    (tree / "club/members.md").write_text("no vector for this")
    assert run("index", f"{tree}/club", "--no-embed")[0] == 0
    code, out = run("search", "plots")
    assert "1 files have no vector" in out.err
    assert cli.main(["model"]) == 0 and run("config")[0] == 0 and "extra_ignores=['leek.txt']" in run("config")[1].out


def test_stream_equals_batch(spark, tmp_path):
    from ferrule.streaming import ingest as stream

    for i in range(3):
        spark.createDataFrame([(1, "/a", f"text {i}"), (10 + i, f"/b{i}", " x  y ")], "id long, path string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = stream.stream_files(spark, str(tmp_path / "in"), "id long, path string, text string", 1)
    stream.ingest_stream(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {r.path: r.body for r in stream.ingested(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {"/a", "/b0", "/b1", "/b2"} and got["/b0"] == "x y" and got["/a"] in {"text 0", "text 1", "text 2"}
    assert spark.read.parquet(str(tmp_path / "out")).select(F.countDistinct("batch")).first()[0] == 3
