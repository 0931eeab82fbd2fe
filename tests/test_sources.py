import datetime
import json

import pytest
from pyspark.sql import functions as F

from corpusmill.sources.files import changed, crawl, discover, skip_reason
from corpusmill.sources.transcripts import feedback_csv, lines, transcripts


def test_crawl(spark, tmp_path):
    for name, data in {"a/x.py": b"print(1)\n", "a/.git/y.py": b"no", "node_modules/z.js": b"no", "b/n.txt": b"\x00bin", "b/l.txt": "é".encode("latin-1"), "b/w.exe": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = crawl(spark, str(tmp_path))
    got = {r["file_path"].rsplit("/", 2)[-1]: (r["processing_status"], r["content"]) for r in found.collect()}
    assert got == {"x.py": ("success", "print(1)\n"), "n.txt": ("binary", None), "l.txt": ("success", "é")}
    assert changed(found, found).count() == 0 and changed(found, found, force=True).count() == 3


def test_transcripts(spark, tmp_path):
    lines = [json.dumps({"role": "user", "content": "hello"}), "not json", json.dumps({"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool", "name": "t"}, {"type": "text", "text": "b"}]})]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    assert [(r["line"], r["role"], r["text"]) for r in transcripts(spark, str(tmp_path)).orderBy("line").collect()] == [(0, "user", "hello"), (2, "assistant", "a\nb")]


def test_lines_of_files_read_by_several_tasks(spark, tmp_path):
    texts = {f"f{k}.txt": [f"{k} line {i} " + "x" * (i % 40) for i in range(n)] for k, n in enumerate((700, 1, 0, 300))}
    for name, rows in texts.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n" * bool(rows))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "4096")
    try:
        got = {}
        for r in lines(spark, str(tmp_path)).collect():
            got.setdefault(r["file"].rsplit("/", 1)[1], {})[r["line"]] = r["value"]
    finally:
        spark.conf.set(name, before)
    assert got == {n: dict(enumerate(rows)) for n, rows in texts.items() if rows}


def test_first_sightings_forget(spark, tmp_path):
    from corpusmill.streaming.events import drained, first_sightings

    schema = "k string, ts timestamp"
    for rows in ([("a", "00:00"), ("a", "00:05"), ("b", "00:01")], [("z", "09:00")], [("a", "09:01"), ("z", "09:02")]):
        spark.createDataFrame([(k, f"2024-01-01 {t}:00") for k, t in rows], "k string, ts string").selectExpr("k", "cast(ts as timestamp) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = drained(first_sightings(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], "ts"), str(tmp_path / "out"), "append")
    assert sorted(r["k"] for r in out.collect()) == ["a", "a", "b", "z"]


def test_feedback(spark, tmp_path):
    (tmp_path / "edges.csv").write_text("timestamp,source_node,edge_type,target_node,weight,context_summary,command\n2024,c,accepted,f,1.0,s,x\n")
    assert feedback_csv(spark, str(tmp_path)).first()["weight"] == 1.0


@pytest.mark.parametrize(
    ("directory", "reason"),
    [("/a/src", None), ("/a/.git", "hidden"), ("/a/target", "system"), ("/a/Lib", "system"), ("/a/lib", None), ("/a/linux-6.1", "denied"), ("/a/xlinux-6.1", None), ("/a/webkit", "denied"), ("/a" * 20, "too deep"), ("/a" * 19, None), ("/keep/.git/target", None), ("/keeper/target", "system")],
)
def test_skip_reason(spark, directory, reason):
    assert spark.range(1).select(skip_reason(F.lit(directory), ["/keep"]).alias("r")).first()["r"] == reason


def test_discover(spark, tmp_path):
    for name in ("a/x.py", "a/Y.MD", "a/yarn.lock", "a/z.js", "target/t.py", "b/.h/kept.txt", "b/.i/no.txt", "chromium-1/c.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    names = lambda df: {r["file_path"][len(str(tmp_path)) + 1 :] for r in df.collect()}
    assert names(discover(spark, str(tmp_path), allowed=[str(tmp_path / "b/.h")])) >= {"a/x.py", "a/Y.MD"}
    assert names(discover(spark, str(tmp_path))) == {"a/x.py", "a/Y.MD"}
    assert names(discover(spark, str(tmp_path), denied=(), suffixes=(".py", ".js"))) == {"a/x.py", "a/z.js", "chromium-1/c.py"}
    assert not names(discover(spark, str(tmp_path), since=datetime.datetime.now() + datetime.timedelta(days=2)))
    plan = discover(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length" in plan and "content" not in plan
