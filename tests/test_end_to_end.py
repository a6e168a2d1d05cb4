import json

import pytest
from pyspark.sql import functions as F

from millrace import agent as agents
from millrace import providers, runner
from millrace.errors import AskError, EvalError, ProviderFailure, ScanError, SettingsError
from millrace.index import Index
from millrace.sources import evalsets, files, settings
from millrace.streaming import ingest as streams

ALPHA = "def load(path):\n    return open(path).read()\n\n\ndef save(path, text):\n    open(path, 'w').write(text)\n"
BETA = "class Store:\n    def fetch(self, key):\n        return self.rows[key]\n\n\ndef helper():\n    return 1\n"


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src/alpha.py").write_text(ALPHA)
    (root / "src/beta.py").write_text(BETA)
    (root / "src/gen.py").write_text("x = 1\n")
    (root / "src/notes.txt").write_text("nothing\n")
    (root / "run").write_text("#!/usr/bin/env python3.11\nprint(1)\n")
    (root / "data.go").write_bytes(b"a\0b")
    (root / "node_modules").mkdir()
    (root / "node_modules/x.js").write_text("var a\n")
    (root / ".gitignore").write_text("gen.*\n!keep.py\n")
    return root


def test_ignore_rules():
    rules = files.IgnoreRules(["*.log", "!keep.log", "/top", "a/**/z", "build/", "# note", "d?x", "[ab].c"])
    for path, want in (("x.log", True), ("q/x.log", True), ("keep.log", False), ("top", True), ("q/top", False), ("a/z", True), ("a/b/c/z", True), ("build/", True), ("q/build/y", True), ("build", False), ("dox", True), ("d/x", False), ("a.c", True), ("c.c", False)):
        assert rules.ignores(path) is want, path


def test_ignore_rules_as_a_relation(spark):
    """The same answers as those of one rule after the other on the way down a tree."""
    lines = {"": ["*.log", "build/", "!keep.log", "/top", "a/**/z", "# note", "d?x"], "a/": ["*.txt", "!x.txt"], "a/b/": ["!y.txt", "keep.log"], "build/": ["!in.c"]}
    paths = ["x.log", "keep.log", "a/keep.log", "a/b/keep.log", "a/x.txt", "a/w.txt", "a/b/y.txt", "y.txt", "build/in.c", "q/build/c", "build", "top", "q/top", "a/z", "a/b/c/z", "a/zz", "dox", "a/dox/e/f.c", "plain"]

    def stays(path):
        parts, above = path.split("/"), list(lines[""])
        for n in range(1, len(parts) + 1):
            step = "/".join(parts[:n]) + "/" * (n < len(parts))
            if files.IgnoreRules(above).ignores(step):
                return False
            above += lines.get(step, [])
        return True

    rules = spark.createDataFrame([(repo, f, n, x) for repo in ("r", "s") for f, own in lines.items() for n, x in enumerate(own) if repo == "r" or f], "repo_id string, folder string, number long, line string")
    got = files.unignored(spark.createDataFrame([(r, p) for r in ("r", "s", "t") for p in paths], "repo_id string, path string"), rules).collect()
    assert {x.path for x in got if x.repo_id == "r"} == set(filter(stays, paths))
    assert {x.path for x in got if x.repo_id == "t"} == set(paths) and {"x.log", "top"} < {x.path for x in got if x.repo_id == "s"}


def test_scan_and_counts(spark, folder):
    rows = files.scan(spark, str(folder), "r")
    assert {r.path: r.language for r in rows.collect()} == {"src/alpha.py": "python", "src/beta.py": "python", "src/notes.txt": None, "run": "python", ".gitignore": None}
    chunks, stats = files.ingest(rows)
    got = stats.first()
    assert (got.files_seen, got.files_skipped_no_language, got.files_chunked, got.chunks_emitted, got.files_skipped_unchanged) == (5, 2, 3, 6, 0)
    again = files.ingest(rows, rows)[1].first()
    assert again.files_skipped_unchanged == 5 and again.chunks_emitted == 0
    with pytest.raises(ScanError):
        files.scan(spark, str(folder / "none"), "r")
    with pytest.raises(ScanError):
        files.scan(spark, str(folder), " ")


@pytest.fixture
def index(spark, folder, tmp_path):
    made = Index(spark, str(tmp_path / "index"), providers.HashingEmbedder(64))
    made.first = made.ingest(str(folder), "r")
    return made


def test_index_twice_and_prune(index, folder):
    assert index.first["chunks_embedded"] == 6 and index.first["edges"] == 5
    assert index.ingest(str(folder), "r")["chunks_embedded"] == 0
    (folder / "src/alpha.py").write_text(ALPHA.replace("return", "yield"))
    changed = index.ingest(str(folder), "r", prune=True)
    assert changed["chunks_embedded"] == 1 and changed["chunks_pruned"] == 1 and index.chunks.count("r") == 6 == index.vectors.count()


def test_repositories_stay_apart(index, folder):
    other = folder.parent / "other"
    (other / "src").mkdir(parents=True)
    (other / "src/alpha.py").write_text("def only_here():\n    return 1\n")
    index.ingest(str(other), "s")
    names = lambda repo: {r.name for r in index.symbols.read().filter(F.col("repo_id") == repo).collect()}
    assert names("s") == {"alpha", "only_here"} and "only_here" not in names("r")
    assert {r.chunk_id for r in index.postings.read().collect()} == {r.chunk_id for r in index.chunks.read().collect()} == {r.chunk_id for r in index.lengths.read().collect()}
    gone = index.delete_repo("s")
    assert gone["chunks"] == gone["vectors"] == gone["lengths"] == 1 and gone["symbols"] == 2 and index.chunks.count("s") == index.postings.count("s") == 0
    assert index.chunks.count("r") == 6 and not list(folder.parent.glob("index/staged/*"))


def test_ask_with_tools(index):
    calls = (providers.Call("1", "find_symbol", {"name": "load"}), providers.Call("2", "open_file", {"path": "src/beta.py", "start_line": 1, "end_line": 2}), providers.Call("3", "nope", {}), providers.Call("4", "find_symbol", {"wrong": 1}))
    chat = providers.ScriptedChat([providers.Reply("", calls, providers.Usage(5, 1)), providers.Reply("It reads a file.", usage=providers.Usage(7, 3), finish_reason="stop")])
    answer = agents.Agent(index, chat, "r").ask("Where is load of a path defined?")
    assert answer.text == "It reads a file." and answer.usage == providers.Usage(12, 4)
    assert answer.citations[0]["path"].startswith(("src/", "run"))
    told = [json.loads(m.content) for m in chat.asked[1] if m.role == "tool"]
    assert told[0]["results"][0]["path"] == "src/alpha.py" and len(told[1]["chunks"]) == 2 and "error" in told[2] and "error" in told[3]
    with pytest.raises(AskError):
        agents.Agent(index, chat, "r").ask("  ")
    looping = providers.ScriptedChat([providers.Reply("", calls[:1])])
    assert agents.Agent(index, looping, "r", max_tool_rounds=2).ask("load?").text == agents.DECLINED and len(looping.asked) == 3


def test_the_default_model_answers_with_the_first_block(index):
    answer = agents.Agent(index, providers.chat_model("extract"), "r").ask("where is save of a path and text")
    assert answer.text.startswith("src/alpha.py, lines ") and "def save(path, text):" in answer.text and answer.citations
    assert agents.Agent(index, providers.chat_model("extract"), "r").ask("???").text == agents.DECLINED  # no term, no direction


def test_match_texts_of_an_index(index):
    symbols = {r.chunk_id: r.symbol for r in index.chunks.read().collect()}
    names = lambda text: sorted(filter(None, (symbols[r.chunk_id] for r in index.match(text).collect())))
    assert names("symbol: load") == ["load"] and names('"open path"') == ["load", "save"] and names("return NOT open") == ["Store", "fetch", "helper"]
    assert names("sym*") == [] and names("symbol: sto*") == ["Store"]


def test_a_flush_rewrites_touched_buckets_only(spark, tmp_path):
    made = Index(spark, str(tmp_path / "index"), providers.HashingEmbedder(8))
    row = lambda i: ("%032d" % i, "r", f"p{i}.txt", "text", "block", None, 1, 2, f"text number {i}", "%08d" % i)
    from millrace.schema import CHUNKS

    frame = lambda ids: spark.createDataFrame([row(i) for i in ids], CHUNKS)
    assert made.add(frame(range(200)))["chunks_embedded"] == 200
    files = lambda: {p: p.stat().st_mtime_ns for name in ("chunks", "vectors", "postings", "lengths") for p in (tmp_path / "index" / name).rglob("*.parquet")}
    before = files()
    assert made.add(frame(range(100)))["chunks_cached"] == 100 and files() == before  # nothing new: nothing is written
    made.add(frame([500]))
    after = files()
    touched = {p.parent for p in set(before) ^ set(after)}
    assert len(touched) == 4 and made.chunks.count() == 201 == made.vectors.count() and len({p.parent for p in after}) > 40
    gone = frame(range(150)).filter("chunk_id < '%032d'" % 150)
    assert made.add(gone, prune=True)["chunks_pruned"] == 51 and made.lengths.count() == 150


def test_rows_without_a_repository_are_refused(spark, tmp_path):
    from millrace.operators import store

    table = store.Table(spark, str(tmp_path / "t"), "repo_id string, chunk_id string, n int")
    make = lambda *rows: spark.createDataFrame(list(rows), "repo_id string, chunk_id string, n int")
    assert table.upsert(make(("r", "a", 1), ("s", "b", 2))) == 2
    for bad in (None, ""):
        with pytest.raises(Exception, match="a row needs a repo_id"):
            table.upsert(make((bad, "z", 3)))
    table.upsert(make(("r", "a", 4)))
    assert {tuple(r) for r in table.read().select("repo_id", "chunk_id", "n").collect()} == {("r", "a", 4), ("s", "b", 2)}
    table.swap(make().limit(0), make(("r", "a", 0)).select("repo_id", "chunk_id"))
    assert [tuple(r) for r in table.read().collect()] == [("s", "b", 2)] or table.count() == 1


def test_many_questions_in_one_job(spark, index):
    questions = [("q1", "where is load of a path"), ("q2", "fetch a key of rows"), ("q3", "???"), ("q4", "helper")]
    many = index.retrieve_many(spark.createDataFrame(questions, "query_id string, question string"), 3).collect()
    for name, text in questions:
        one = [(r.chunk_id, r.score, r["rank"]) for r in index.retrieve(text, 3).collect()]
        assert sorted(((r.chunk_id, r.score, r["rank"]) for r in many if r.query_id == name), key=lambda x: x[2]) == one


def test_stream_of_tokens(index):
    chat = providers.ScriptedChat([providers.Reply("two words", usage=providers.Usage(1, 2))])
    events = list(agents.Agent(index, chat, "r").ask_stream("what is fetch"))
    assert [e.type for e in events] == ["token", "token", "done"] and events[-1].answer.text == "two words"
    sent = list(agents.server_sent(iter([agents.Event("token", "a\nb"), events[-1]])))
    assert sent[0] == "data: a\ndata: b\n\n" and sent[1].startswith("event: done\n")


def test_evaluation_run(spark, index, tmp_path):
    (tmp_path / "cases.yaml").write_text("cases:\n- {case_id: c1, repo_id: r, question: where is load, expected_files: [src/alpha.py], expected_answer_traits: [short]}\n- {case_id: c2, repo_id: r, question: fetch a key}\n")
    (tmp_path / "rates.yaml").write_text("extract: {default: {prompt_per_1k: 1.0, completion_per_1k: 2}}\n")
    cases, rates = evalsets.cases(spark, str(tmp_path / "cases.yaml")), evalsets.rates(spark, str(tmp_path / "rates.yaml"))
    judge = providers.ScriptedChat([providers.Reply('{"per_trait": {"short": "yes"}}')])
    run_id, measured, total = runner.run(spark, agents.Agent(index, providers.ExtractChat(), "r"), judge, cases, index.chunks.read(), rates, "extract", "m", 5)
    rows = {r.case_id: r for r in measured.collect()}
    assert rows["c1"].recall_at_k == 1.0 and rows["c1"].correctness == 1.0 and rows["c2"].correctness == 1.0 and len(judge.asked) == 1
    assert rows["c1"].grounding_rate == 1.0 and total.first().total_cost_usd > 0
    (tmp_path / "bad.yaml").write_text("cases:\n- {case_id: c1, repo_id: r, question: q}\n- {case_id: c1, repo_id: r, question: q}\n")
    with pytest.raises(EvalError):
        evalsets.cases(spark, str(tmp_path / "bad.yaml"))


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("chat: {model: filed, temperature: 1.5}\napp: {log_level: DEBUG}\n")
    (tmp_path / ".env").write_text("MILLRACE_CHAT__MODEL=dotted\nMILLRACE_EMBEDDINGS__DIMENSION=16\n")
    got = settings.load(str(tmp_path / "s.yaml"), str(tmp_path / ".env"), {"MILLRACE_CHAT__MODEL": "env"}, chat={"max_tokens": 5})
    assert (got.chat.model, got.chat.temperature, got.chat.max_tokens, got.embeddings.dimension, got.app.log_level) == ("env", 1.5, 5, 16, "DEBUG")
    with pytest.raises(SettingsError):
        settings.load(None, None, {"MILLRACE_CHAT__TEMPERATURE": "9"})


def test_providers(spark):

    rows = spark.createDataFrame([("a",), ("b",)], "content string")
    assert providers.embedded(rows, providers.HashingEmbedder(8)).select("vector").first()[0].__len__() == 8
    with pytest.raises(Exception, match="another dimension"):
        providers.embedded(rows, _wrong()).collect()
    with pytest.raises(ProviderFailure):
        providers.embedder("nobody")


def _wrong():
    from types import SimpleNamespace

    class Short(SimpleNamespace):
        def __call__(self, texts):
            return [[0.0] for _ in texts]

    return Short(dimension=8)


def test_stream_of_files(spark, folder, tmp_path):
    made = Index(spark, str(tmp_path / "streamed"), providers.HashingEmbedder(16))
    files.scan(spark, str(folder), "r").write.parquet(str(tmp_path / "in"))
    query = streams.index_stream(streams.file_stream(spark, str(tmp_path / "in")), made, str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert made.chunks.count("r") == 6


def test_command_line(tmp_path, capsys):
    from millrace import cli

    path = str(tmp_path / "m.yaml")
    assert cli.main(["--config", path, "init"]) == 0 and cli.main(["--config", path, "init"]) == 1
    assert settings.load(path, None, {}) == settings.Settings()


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_stream_passes_changed_files_and_reports_silent_ones(spark, tmp_path, one_partition):
    import time

    from millrace.schema import FILES

    def scanned(name, *rows):
        spark.createDataFrame([("r", p, float(m), n, "text", c) for p, m, n, c in rows], FILES).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        time.sleep(1.1)  # files are taken in order of their times

    def run(*wanted):
        """Rows of the stream once these are there; it is stopped then, as timers keep it going."""
        files = streams.file_stream(spark, str(tmp_path / "in") + "/*", 1)
        out = streams.changed_files(files, "6 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out"))
        query, rows = out.trigger(processingTime="1 second").start(), []
        for _ in range(60):
            time.sleep(1)
            rows = sorted((r.path, r.mtime, r.event) for r in spark.read.schema(streams.FILE_EVENTS).parquet(str(tmp_path / "out")).collect()) if (tmp_path / "out").exists() else []
            if set(wanted) <= set(rows):
                break
        query.stop()
        return rows

    scanned("one", ("a", 1, 10, "x"), ("b", 1, 10, "y"))
    scanned("two", ("a", 1, 10, "x"), ("b", 2, 10, "z"))
    first = run(("b", 2.0, "changed"))
    assert [r for r in first if r[2] == "changed"] == [("a", 1.0, "changed"), ("b", 1.0, "changed"), ("b", 2.0, "changed")]
    scanned("three", ("b", 2, 10, "z"), ("b", 2, 11, "zz"), ("c", 5, 1, "c"))
    again = run(("c", 5.0, "changed"), ("a", 1.0, "gone"))  # a restart: what was seen is still known
    assert [r for r in again if r[:2] == ("c", 5.0)][0] == ("c", 5.0, "changed") and ("a", 1.0, "gone") in again
    assert len([r for r in again if r[0] == "a" and r[2] == "changed"]) == 1


def test_node_link_documents(spark, tmp_path):
    import gzip

    from millrace.errors import StoreError
    from millrace.operators import graph

    node = lambda name, path, line: {"id": [path, name], "node_id": [path, name], "name": name, "kind": "function", "path": path, "line": line, "parent": None}
    link = lambda a, b, kind: {"source": ["p/a.py", a], "target": ["p/b.py", b], "key": kind}
    document = {"directed": True, "multigraph": True, "graph": {}, "nodes": [node("a", "p/a.py", 10), node("b", "p/b.py", 20), node("solo", "p/s.py", 1)], "edges": [link("a", "b", "calls"), link("a", "b", "imports")]}
    path = tmp_path / "graph.json.gz"
    path.write_bytes(gzip.compress(json.dumps(document).encode()))
    symbols, links = graph.import_node_link(spark, str(path))
    assert {(r.path, r.name, r.kind, r.line) for r in symbols.collect()} == {("p/a.py", "a", "function", 10), ("p/b.py", "b", "function", 20), ("p/s.py", "solo", "function", 1)}
    assert {(r.src_name, r.dst_path, r.dst_name, r.kind) for r in links.collect()} == {("a", "p/b.py", "b", "calls"), ("a", "p/b.py", "b", "imports")}
    assert [(r.name, r.line) for r in graph.neighbours(symbols, links, "a", callers=False).collect()] == [("b", 20)]
    (tmp_path / "links.json").write_text(json.dumps({k if k != "edges" else "links": v for k, v in document.items()}))
    assert graph.import_node_link(spark, str(tmp_path / "links.json"))[1].count() == 2
    for bad in (b"this is not gzip", gzip.compress(b"{"), gzip.compress(json.dumps({"nodes": [{"id": ["x"]}], "edges": []}).encode()), gzip.compress(b"{}")):
        path.write_bytes(bad)
        with pytest.raises(StoreError):
            graph.import_node_link(spark, str(path))
