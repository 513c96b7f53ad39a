"""Account rules and mutations on inline rows, one case per behaviour."""

from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from entrylake import schemas as S
from entrylake.functions.text import fold_ascii, initials, limiter_key, url_path
from entrylake.operators import mutations as M, quality as Q, users as U

NOW = datetime(2024, 6, 1)


def one(spark, make, value):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(make(F.col("x"))).first()[0]


@pytest.fixture(scope="module")
def people(spark):
    def row(i, name, verified=True, secret=None, confirmed=None):
        at = datetime(2024, 1, 1)
        return (i, name, f"{name.lower()}@x.org", at if verified else None, "hash", secret,
                secret and "[]", confirmed, "tok", at, at)
    rows = [row(1, "Ada"), row(2, "Bob", verified=False), row(3, "Cid", secret="s", confirmed=NOW),
            row(4, "Dan", secret="s")]
    return spark.createDataFrame(rows, S.USERS).cache()


@pytest.mark.parametrize("name,want", [("", ""), ("Bob", "B"), (" Ada  Lovelace ", "AL"), ("a b c", "AC"),
                                       ("  x", "X"), ("éva ñu", "ÉÑ")])
def test_initials(spark, name, want):
    assert one(spark, initials, name) == want


@pytest.mark.parametrize("url,want", [("https://x.com", "/"), ("https://x.com/en/25#top", "/en/25"),
                                      ("http://a b", None), ("/en/1", "/en/1"), ("https://x.com?q=1", "/"),
                                      ("about", "about")])
def test_url_path(spark, url, want):
    assert one(spark, url_path, url) == want


def test_limiter_key_is_folded(spark):
    df = spark.createDataFrame([("JÖSÉ@X.org", "127.0.0.1")], "e string, ip string")
    assert df.select(limiter_key(F.col("e"), F.col("ip"))).first()[0] == "jose@x.org|127.0.0.1"
    assert one(spark, fold_ascii, "straße Œuvre łódź") == "strasse OEuvre lodz"


def test_projections_hide_and_whitelist(spark, people):
    assert U.fillable(people).columns == ["name", "email", "password"]
    public = U.public_users(people)
    assert not set(U.HIDDEN) & set(public.columns) and "initials" in public.columns
    text = U.export_users(people).where("id = 3").first()["json"]
    assert "hash" not in text and "two_factor_secret" not in text and '"email":"cid@x.org"' in text


def test_predicates(people):
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(U.verified(people)) == [1, 3, 4] and ids(U.unverified(people)) == [2]
    assert ids(U.two_factor_enabled(people)) == [3]


def test_login_outcomes(spark, people):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [(i, t(i), "Ada@X.org", "ip", False) for i in range(6)]
    rows += [(10, t(1), "nobody@x.org", "ip", True), (11, t(1), "cid@x.org", "ip", True),
             (12, t(1), "BOB@x.org", "ip", True), (13, t(1), "dan@x.org", "ip", True),
             (14, datetime(2024, 1, 1, 0, 1, 0), "ada@x.org", "ip", True)]
    attempts = spark.createDataFrame(rows, "event_id long, ts timestamp, email string, ip string, password_ok boolean")
    got = {r["event_id"]: r["outcome"] for r in U.login_outcomes(attempts, people).collect()}
    assert got == {**{i: "bad_password" for i in range(5)}, 5: "limited", 10: "unknown", 11: "two_factor",
                   12: "ok", 13: "ok", 14: "ok"}


@pytest.mark.parametrize("name,email,want", [
    ("Al", "a@b.c", ""), ("Al", "a@b", ""), ("  ", "a@b.c", "name.required"), (None, None, "name.required,email.required"),
    ("x" * 256, "a@b.c", "name.max"), ("Al", "a b@c.d", "email.email"), ("Al", "a@", "email.email"),
    ("Al", "a..b@c.d", "email.email"), ("Al", "a" * 250 + "@b.cde", "email.max"), ("", "nope", "name.required,email.email")])
def test_profile_rules(spark, name, email, want):
    df = spark.createDataFrame([(name, email)], "name string, email string")
    assert Q.validate_profile(df).first()["violations"] == want


@pytest.mark.parametrize("password,want", [
    ("Abcdefghij1!", ""), ("Abcdefghi1!", "password.min"), ("abcdefghij1!", "password.mixed"),
    ("123456789012", "password.mixed,password.letters,password.symbols"), ("Abcdefghijk!", "password.numbers"),
    ("Äbcdefghij1 ", ""), ("Abcdefghij12", "password.symbols")])
def test_password_policy(spark, password, want):
    df = spark.createDataFrame([(1, password)], "id int, password string")
    checked = Q.audit_password_policy(df, "production")
    assert checked.columns == ["id", "violations"] and checked.first()["violations"] == want
    assert Q.audit_password_policy(df, "local").first()["violations"] == ""


def test_unique_claims_only_by_valid_rows(spark, people):
    rows = [(1, "n@x.org", False), (2, "n@x.org", True), (3, "n@x.org", True), (4, "ada@x.org", True), (5, "Ada@x.org", True)]
    batch = spark.createDataFrame(rows, "seq long, email string, good boolean")
    got = {r["seq"]: r["taken"] for r in Q.check_unique(batch, people, F.col("good")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False}


def test_unique_ignores_own_row(spark, people):
    rows = [(1, "ada@x.org"), (2, "ada@x.org"), (3, "new@x.org"), (4, "new@x.org")]
    changes = spark.createDataFrame(rows, "id long, email string")
    got = {r["id"]: r["taken"] for r in Q.check_unique_except_self(changes, people).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_audits(spark, people):
    twice = people.unionByName(people.where("id = 1")).withColumn(
        "name", F.when(F.col("id") == 2, None).when(F.col("id") == 3, F.repeat(F.lit("x"), 300)).otherwise(F.col("name")))
    got = {r["rule"]: r["violations"] for r in Q.audit_constraints(twice, Q.USER_RULES).collect()}
    assert {k: v for k, v in got.items() if v} == {"unique:id": 1, "unique:email": 1, "not_null:name": 1, "max:name": 1}
    sessions = spark.createDataFrame([("a", 1), ("b", 99), ("c", None)], "id string, user_id long")
    assert [r["id"] for r in Q.orphan_sessions(sessions, people).collect()] == ["b"]


def test_breached_rows_lose_the_password(spark):
    df = spark.createDataFrame([(1, "pw"), (2, "other")], "id int, password string")
    digests = df.where("id = 1").select(F.sha1("password").alias("digest"))
    found = Q.screen_breached(df, digests)
    assert found.columns == ["id"] and found.first()["id"] == 1


def registration(spark, rows):
    return spark.createDataFrame(rows, "seq long, name string, email string, password string, password_confirmation string")


@pytest.mark.parametrize("rows_per_chunk", [10**6, 3])
def test_register(spark, people, rows_per_chunk):
    batch = registration(spark, [
        (1, "Test User", "Test@Example.com", "password", "password"), (2, "X", "test@example.com", "p", "p"),
        (3, "Y", "ada@x.org", "p", "p"), (4, "Z", "z@x.org", "p", "q"), (5, "Z", "z@x.org", "p", "p")]
        + [(i, "U", f"u{i}@x.org", "p", "p") for i in range(10, 30)])
    done = M.register(people, batch, NOW, rows_per_chunk=rows_per_chunk)
    new = done.users.where("id > 4").orderBy("id").collect()
    assert [(r["id"], r["email"]) for r in new] == [
        (5, "test@example.com"), (6, "z@x.org")] + [(7 + i, f"u{10 + i}@x.org") for i in range(20)]
    assert new[0]["password"] not in ("password", None) and new[0]["email_verified_at"] is None
    assert {r["seq"]: r["violations"] for r in done.rejects.collect()} == {
        2: "email.unique", 3: "email.unique", 4: "password.confirmed"}
    assert done.users.schema.names == people.schema.names


def test_register_into_an_empty_table(spark, people):
    done = M.register(people.where("false"), registration(spark, [(1, "A", "a@x.org", "p", "p")]), NOW)
    assert [r["id"] for r in done.users.collect()] == [1]


def test_profile_update(spark, people):
    changes = spark.createDataFrame([(1, "Test User", "test@example.com"), (3, "Cid", "cid@x.org"),
                                     (4, "Dan D", "dan@x.org"), (2, "", "bob@x.org")],
                                    "id long, name string, email string")
    got = {r["id"]: r for r in M.update_profiles(people, changes, NOW).collect()}
    assert (got[1]["name"], got[1]["email"], got[1]["email_verified_at"]) == ("Test User", "test@example.com", None)
    assert got[1]["updated_at"] == NOW and got[3]["updated_at"] == datetime(2024, 1, 1)
    assert got[4]["email_verified_at"] is not None and got[4]["name"] == "Dan D"
    assert got[2]["name"] == "Bob"


def test_delete_and_overwrite(spark, people):
    ids = spark.createDataFrame([(2,), (2,), (77,)], "id long")
    assert sorted(r["id"] for r in M.delete_users(people, ids).collect()) == [1, 3, 4]
    changes = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (9, 1, "x")], "id long, seq long, password string")
    got = {r["id"]: r["password"] for r in M.overwrite_column(people, changes, "password", "seq").collect()}
    assert got == {1: "new", 2: "hash", 3: "hash", 4: "hash"}


def test_email_verification(spark, people):
    t0 = datetime(2024, 2, 1)
    good, at = "bob@x.org", lambda m: datetime(2024, 2, 1, m // 60, m % 60)
    rows = [(1, 2, "wrong", at(1), t0), (2, 2, good, at(61), t0), (3, 2, good, at(60), t0), (4, 2, good, at(50), t0),
            (5, 123, good, at(1), t0), (6, 1, "ada@x.org", at(1), t0)]
    clicks = spark.createDataFrame(rows, "event_id long, id long, h string, ts timestamp, issued_at timestamp") \
        .withColumn("hash", F.sha1("h"))
    done = M.apply_verifications(people, clicks)
    assert [(r["id"], r["event_id"]) for r in done.events.collect()] == [(2, 4)]
    got = {r["id"]: r["email_verified_at"] for r in done.users.collect()}
    assert got[2] == at(50) and got[1] == datetime(2024, 1, 1) and len(got) == 4


def test_worklist(spark, people):
    asked = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    assert [r["id"] for r in M.verification_worklist(asked, people).collect()] == [2]


pairs = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9), st.booleans()), max_size=12)


@settings(max_examples=12, deadline=None)
@given(pairs, pairs)
def test_upsert_property(spark, base, changes):
    base = list({k: (k, s, f"b{s}") for k, s, _ in base}.values())
    changes = [(k, s, f"c{i}", "delete" if gone else "put")
               for i, (k, s, gone) in enumerate({(c[0], c[1]): c for c in changes}.values())]
    want = {k: (s, v) for k, s, v in base}
    for k, s, v, op in sorted(changes, key=lambda c: c[1]):
        top = max(c[1] for c in changes if c[0] == k)
        if s == top and (k not in want or s >= want[k][0] or want[k][1].startswith("c")):
            want.pop(k, None)
            if op != "delete":
                want[k] = (s, v)
    b = spark.createDataFrame(base, "k int, seq int, v string")
    c = spark.createDataFrame(changes, "k int, seq int, v string, op string")
    once = M.upsert(b, c, ["k"], "seq", "op")
    assert {r["k"]: (r["seq"], r["v"]) for r in once.collect()} == want
    again = M.upsert(once, c, ["k"], "seq", "op")
    assert {r["k"]: (r["seq"], r["v"]) for r in again.collect()} == want
