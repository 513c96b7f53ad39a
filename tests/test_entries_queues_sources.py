"""Entries, queue rollups, table files and generated accounts on small inputs."""

import pytest
from pyspark.sql import functions as F

from entrylake import schemas as S
from entrylake.operators import entries as E, queues as J
from entrylake.session import work_dir
from entrylake.sources import generate as G, tables as B

FENCE = "```"


def entries(spark, rows):
    return spark.createDataFrame(rows, "id long, body string, category string, tags array<string>")


@pytest.fixture(scope="module")
def some(spark):
    return entries(spark, [(1, "a", "x", ["p", "q"]), (2, "b", "x", ["q", "q"]), (3, "c", "y", []), (4, "d", None, ["p"])])


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_ingest(spark):
    raw = entries(spark, [(1, "text", "c", [" B", "a", "b ", ""]), (2, " \n", "c", None), (None, "t", "c", None),
                          (4, "t", "c" * 300, None), (5, "t", "c", None)])
    done = E.ingest_entries(raw)
    good = {r["id"]: r for r in done.entries.collect()}
    assert good[1]["tags"] == ["a", "b"] and good[5]["tags"] == [] and len(good[1]["content_hash"]) == 64
    assert {r["id"]: r["violations"] for r in done.rejects.collect()} == {
        2: "body.required", None: "id.required", 4: "category.max"}


def test_filter_and_read(spark, some):
    assert ids(E.filter_entries(some, "x")) == [1, 2]
    assert ids(E.filter_entries(some, any_tags=["p", "z"])) == [1, 4]
    assert ids(E.filter_entries(some, all_tags=["p", "q"])) == [1]
    assert ids(E.get_entries(some, spark.createDataFrame([(2,), (2,), (9,)], "id long"))) == [2]


def test_facets_and_bridge(some):
    got = {(r["facet"], r["value"]): r["entries"] for r in E.facet_counts(some).collect()}
    assert got == {("category", "x"): 2, ("category", "y"): 1, ("tag", "p"): 2, ("tag", "q"): 2}
    back = E.bridge_to_tags(E.tags_to_bridge(some).union(E.tags_to_bridge(some)))
    assert {r["entry_id"]: r["tags"] for r in back.collect()} == {1: ["p", "q"], 2: ["q"], 4: ["p"]}


def test_changes(spark, some):
    changes = spark.createDataFrame(
        [(1, "new", "x", ["p"], 1, "update"), (2, "", "x", ["p"], 2, "delete"), (9, "n", "z", ["p"], 3, "create"),
         (1, "newer", "x", ["p"], 5, "update")], "id long, body string, category string, tags array<string>, seq long, op string")
    got = {r["id"]: r["body"] for r in E.apply_entry_changes(some, changes).collect()}
    assert got == {1: "newer", 3: "c", 4: "d", 9: "n"}


def test_code_fences(spark):
    bodies = {1: "plain", 2: f"a\n{FENCE}js\nx = 1;\n{FENCE}\nb", 3: f"{FENCE}\none\n{FENCE}\n\n{FENCE}sql\ntwo\nlines\n{FENCE}",
              4: f"{FENCE}py\nopen end", 5: f"inline {FENCE}no{FENCE} fence"}
    df = spark.createDataFrame(list(bodies.items()), "id long, body string")
    got = sorted((r["entry_id"], r["pos"], r["lang"], r["content"]) for r in E.extract_code(df).collect())
    assert got == [(2, 0, "js", "x = 1;\n"), (3, 0, None, "one\n"), (3, 1, "sql", "two\nlines\n"), (4, 0, "py", "open end")]


def test_links(spark):
    df = spark.createDataFrame([(1, "<a href=\"/a\">x</a> <A class='c' HREF='http://b/c'>y</A> <abbr href=\"/no\">"),
                                (2, "[t](/m) ![i](/i.png) [u](http://x/y)")], "id long, t string")
    html = E.extract_links(df.where("id = 1"), "id", "t").collect()
    assert [(r["pos"], r["content"]) for r in html] == [(0, "/a"), (1, "http://b/c")]
    markdown = E.extract_links(df.where("id = 2"), "id", "t", "markdown").collect()
    assert [r["content"] for r in markdown] == ["/m", "http://x/y"]


def test_hits_with_resources(spark):
    hits = spark.createDataFrame([(1, 1, 7, 0.5), (1, 2, 8, 0.4), (2, 1, 7, 0.3)], "q_id long, rnk int, id long, score double")
    own = spark.createDataFrame([(7, 0, "code", "sql", "x"), (7, 1, "link", None, "/l"), (9, 0, "link", None, "/n")],
                                "entry_id long, pos int, kind string, lang string, content string")
    got = sorted((r["q_id"], r["rnk"], r["id"], r["content"] or "") for r in E.with_resources(hits, own).collect())
    assert got == [(1, 1, 7, "/l"), (1, 1, 7, "x"), (1, 2, 8, ""), (2, 1, 7, "/l"), (2, 1, 7, "x")]


def test_stale(spark, some):
    done = some.where("id < 4").select(F.col("id").alias("entry_id"), F.when(F.col("id") == 2, "old").otherwise(
        E.content_hash(F.col("body"))).alias("content_hash"))
    now = some.withColumn("content_hash", E.content_hash(F.col("body")))
    assert ids(E.stale_entries(now, done)) == [2, 4]


def test_queue_states(spark):
    rows = [(1, "a", None, 90, 10), (2, "a", None, 101, 20), (3, "a", 10, 0, 30), (4, "a", 9, 0, 40), (5, "b", None, 100, 50)]
    jobs = spark.createDataFrame(rows, "id long, queue string, reserved_at long, available_at long, created_at long")
    got = {r["queue"]: tuple(r)[1:] for r in J.queue_backlog(jobs, 100).collect()}
    assert got == {"a": (1, 1, 1, 1, 90), "b": (1, 0, 0, 0, 50)}
    assert [(r["queue"], r["id"], r["rnk"]) for r in J.oldest_waiting(jobs, 200, 1).orderBy("queue").collect()] == [
        ("a", 1, 1), ("b", 5, 1)]


def test_top_k_per_queue_is_cut_before_the_shuffle(spark, small):
    jobs = spark.range(10).selectExpr("id", "cast(id % 3 as string) queue", "cast(null as long) reserved_at", "0L available_at", "0L created_at")
    plan = J.oldest_waiting(jobs, 10, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_batches(spark):
    rows = [(1, 1, "finished"), (1, 2, "failed"), (2, 3, "pending"), (2, 4, "finished"), (2, 5, "finished"), (3, 6, "finished")]
    members = spark.createDataFrame(rows, "batch_id long, job_id long, status string")
    got = {r["batch_id"]: (r["total_jobs"], r["pending_jobs"], r["failed_jobs"], r["percent"], r["status"])
           for r in J.batch_progress(members).collect()}
    assert got == {1: (2, 0, 1, 100, "failed"), 2: (3, 1, 0, 66, "running"), 3: (1, 0, 0, 100, "finished")}
    assert [tuple(r) for r in J.failed_members(members).collect()] == [(1, 2)]


def test_snapshots(spark):
    root = work_dir(spark, "test")
    with pytest.raises(FileNotFoundError):
        B.read_snapshot(spark, root, "t")
    assert B.write_snapshot(spark.range(3), root, "t") == 1
    assert B.write_snapshot(B.read_snapshot(spark, root, "t").where("id > 0"), root, "t", sort_by=["id"]) == 2
    assert B.read_snapshot(spark, root, "t").count() == 2 and B.read_snapshot(spark, root, "t", version=1).count() == 3
    spark.range(99).write.parquet(f"{root}/t/data/v=3")       # a job that died before its commit
    assert B.read_snapshot(spark, root, "t").count() == 2
    assert B.write_snapshot(spark.range(5), root, "t") == 3 and B.read_snapshot(spark, root, "t").count() == 5
    with pytest.raises(FileNotFoundError):
        B.read_snapshot(spark, root, "t", version=9)


def test_partitioned_snapshot_prunes(spark):
    root = work_dir(spark, "test")
    jobs = spark.range(300).selectExpr("id", "concat('q', id % 3) as queue")
    B.write_snapshot(jobs, root, "jobs", sort_by=["id"], partition_by=["queue"])
    one = B.read_snapshot(spark, root, "jobs").where("queue = 'q1'")
    assert one.count() == 100
    assert "PartitionFilters: [isnotnull(queue" in one._jdf.queryExecution().executedPlan().toString()


def test_schemas_and_evolution(spark):
    assert S.USERS.names == ["id", "name", "email", "email_verified_at", "password", "two_factor_secret",
                             "two_factor_recovery_codes", "two_factor_confirmed_at", "remember_token", "created_at", "updated_at"]
    assert len(S.TABLES) == 11 and S.SESSIONS["last_activity"].dataType.typeName() == "long"
    old = B.evolve(G.gen_users(spark, 5), S.USERS_V1)
    new = B.evolve(old, S.USERS)
    assert old.columns == S.USERS_V1.names and [f.dataType for f in new.schema] == [f.dataType for f in S.USERS]
    assert new.where("two_factor_secret is null").count() == 6


def test_generated_users(spark):
    users = G.gen_users(spark, 2000, unverified_pct=25, two_factor_pct=40).cache()
    assert users.count() == 2001 and users.select("email").distinct().count() == 2001
    seed = users.where("email = 'test@example.com'").first()
    assert seed["name"] == "Test User" and seed["email_verified_at"] is not None
    assert 400 < users.where("email_verified_at is null").count() < 600
    on = users.where("two_factor_secret is not null")
    assert 700 < on.count() < 900 and on.where("two_factor_confirmed_at is null").count() == 0
    none = G.gen_users(spark, 100)
    assert none.where("email_verified_at is null or two_factor_secret is not null").count() == 0


def test_jdbc_options():
    got = B.jdbc_options("jdbc:x", "users", "id", 1, 1000, 8)
    assert (got["partitionColumn"], got["lowerBound"], got["upperBound"], got["numPartitions"]) == ("id", "1", "1001", "8")
    with pytest.raises(ValueError):
        B.jdbc_options("jdbc:x", "users", "id", 5, 1, 8)


def test_read_table_prunes(spark, small):
    schema = spark.read.parquet(f"{small}/customer.parquet").schema
    df = B.read_table(spark, small, "customer.parquet", schema).where("c_custkey > 140").select("c_name")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_custkey,140)" in plan and "c_mktsegment" not in plan


def test_small_inputs_are_spread(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert B.spread_small(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
