import hashlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from panelkite.llm import lines

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, chars=40, copies=5):
    held = defaultdict(set)
    key = lambda line: line.strip(BLANK).translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [p for p in parts if len(held.get(key(p), ())) < copies or max(held[key(p)]) == i]
        out.append((i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def got(df):
    done = lines.marked(df)
    return sorted((r["doc_id"], r["line_count"], r["line_dropped"], hashlib.sha256(r["line_kept"].encode()).hexdigest()) for r in done.collect())


def test_whole_table(spark, sf_dir, docs, texts):
    want = brute(sorted(texts.items()))
    assert got(docs) == want
    rows = sorted(tuple(r) for r in lines.op6_lines(spark, sf_dir).collect())
    assert rows == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(con.sql(lines.SQL).select("doc_id, n_lines, n_dropped, kept_sha256").fetchall()) == want


def test_planted_lines(spark):
    long = "This very line is repeated in many documents, word by word."
    rows = [(i, f"own line {i}\n  {long.upper() if i % 2 else long}\t\n{long}" if i < 9 else f"own {i}\n{long[:39]}") for i in range(20)]
    rows += [(50 + i, "Four documents hold this line, which is one too few.") for i in range(4)]
    rows += [(90, "\n\n"), (91, ""), (92, None)]
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_runs_are_merged_by_level(spark):
    log = lines.LineRuns(fanout=2)
    for k in range(5):
        log.add(spark.createDataFrame([(h, 0, 1, 100 - k) for h in range(k, k + 3)], "hi bigint, lo bigint, n bigint, top bigint"))
    assert [len(level) for level in log.levels] == [1, 0, 1]
    merged = {r["hi"]: (r["n"], r["top"]) for r in log.merged(log.runs()).collect()}
    assert merged == {0: (1, 100), 1: (2, 100), 2: (3, 100), 3: (3, 99), 4: (3, 98), 5: (2, 97), 6: (1, 96)}


def test_the_anti_join_decides_who_keeps_a_line(spark, monkeypatch):
    long = "This very line is repeated in many documents, word by word."
    df = spark.createDataFrame([(i, f"{long}\nown line of document {i}") for i in range(40)], "doc_id bigint, text string")
    assert {i for i, _, dropped, _ in got(df) if not dropped} == {39}
    monkeypatch.setattr(lines.LineRuns, "fresh", lambda self, batch: batch.select("hi", "lo", "top"))
    assert {i for i, _, dropped, _ in got(df) if not dropped} != {39}


def test_runs_are_joined_as_they_lie(spark):
    import re

    log = lines.LineRuns(fanout=3)
    one = lambda start: spark.range(start, start + 3000).selectExpr("id AS hi", "id * 7 AS lo", "1L AS n", "id AS top")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        log.add(one(0))
        log.add(one(1500))
        plan = log.merged(log.runs())._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        plan = log.fresh(one(9))._jdf.queryExecution().executedPlan().toString()
        # Only the batch itself is dealt out.
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "LeftAnti" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert log.merged(log.runs()).agg(F.sum("n"), F.count("top")).first()[:] == (6000, 4500)


def test_batches_follow_the_documents(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(lines, "BATCH_ROWS", 30)
    assert lines.long_lines(docs)[1] == -(-len(texts) // 30)
    assert got(docs) == brute(sorted(texts.items()))


def test_odd_rows(odd, empty):
    rows = lines.marked(odd.withColumn("line_no", F.lit(1))).collect()
    assert len(rows) == 9
    assert {r["doc_id"]: r["line_count"] for r in rows}[2] == 1
    assert lines.dedup(empty).columns == empty.columns and lines.dedup(empty).count() == 0
