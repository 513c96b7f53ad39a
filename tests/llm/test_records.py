"""Operators 5, 6, 8 and 9."""

import gzip
import hashlib
import random
import zlib

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from entrylake.llm import chat, packing, queries, urls, warc
from entrylake.llm.common import table
from helpers import ODD_TEXTS

# --- URLs

URLS = [None, "", "no scheme.com/x", "http://A.B.Example.COM:80/en/x?q#f", "https://u:p@www.example.com/en/", "http://example.com", "http://example.com?/en/",
        "x://y://z/p", "http://net/es/", "http://a.net/fr/#x", "http://anet/es/1", "http://notexample.com/en/", "http://1.2.3.4/a", "http://a.co.uk/x",
        "http://É.com/É?é", "http:///path", "http://h.com/é\n/x"]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:at], rest[at:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def test_rules_against_plain_version(spark):
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(URLS)] + [(0, None, "x", 1.0)], "page_id long, url string, host string, bound double")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = urls.filter_urls(pages, none, queries.RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = plain_parts(URLS[r.page_id])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule.host + rule.path, rule.action if rule else "allow")
    assert urls.filter_urls(pages.limit(0), none, queries.RULES).count() == 0


def test_names_suffixes_and_domains(spark):
    cases = {"a.b.example.com": ("com", "example.com"), "example.com": ("com", "example.com"), "com": ("com", "com"), "x.y.co.uk": ("co.uk", "y.co.uk"),
             "co.uk": ("co.uk", "co.uk"), "u@h.example.org.:80": ("org", "example.org"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "": ("", "")}
    hosts = spark.createDataFrame([(h,) for h in cases], "host string")
    name = urls.name_of(F.col("host"))
    for r in hosts.select("host", urls.suffix_of(name).alias("s"), urls.domain_of(name, urls.suffix_of(name)).alias("d")).collect():
        assert (r.s, r.d) == cases[r.host]


def test_reputation_shrinks_and_blocks_on_evidence(spark):
    rng = random.Random(2)
    rows, pid = [], 0
    for h in range(40):
        bad = 0.95 if h < 4 else 0.05
        for _ in range(60):
            rows.append((pid, f"http://h{h}.d{h % 20}.org/x", rng.random() < bad))
            pid += 1
    rows += [(pid + i, u, True) for i, u in enumerate(["http://one.single.org/", "http://new.d0.org/"])]
    pages = spark.createDataFrame([r[:2] for r in rows] + [(-1, "http://unseen.else.net/q")], "page_id long, url string")
    outcomes = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(-5, True), (0, None)], "page_id long, bad boolean")
    hosts = pages.select(urls.host_of(F.col("url")).alias("host")).distinct()
    known = pages.join(outcomes.where("bad is not null"), "page_id").select(urls.host_of(F.col("url")).alias("host"), "bad")
    bound = {r.host: r.bound for r in urls.reputation(known, hosts).collect()}
    assert all((bound[f"h{h}.d{h % 20}.org"] > urls.LIMIT) == (h < 4) for h in range(40))
    assert bound["one.single.org"] < urls.LIMIT and bound["unseen.else.net"] < urls.LIMIT
    assert bound["new.d0.org"] > bound["one.single.org"]
    verdicts = {r.host: r.verdict for r in urls.filter_urls(pages, outcomes, queries.RULES).collect()}
    assert all((v == "block") == (bound[h] > urls.LIMIT) for h, v in verdicts.items())


# --- WARC

PAGE = ("<!DOCTYPE html><html lang='de'><head><title> A &amp;\n B </title><style>p{}</style></head><body><!-- <a href='/no'>x</a> --><p>One <b>two</b></p>"
        "<script>var a = '</p><a href=\"/no2\">';</script><a href=\"/x?a=1&amp;b=2\">link</a><br>three &lt;4&gt;  five<ul><li>six</ul></body></html>")


def test_page_text_and_links():
    assert warc.page_text(PAGE) == "One two\nlink\nthree <4> five\nsix"
    assert warc.links(PAGE) == ["/x?a=1&b=2"]
    assert warc.page_text("") == "" and warc.page_text("<p") == "<p" and warc.page_text("<script>never closed") == ""


def response(block, **more):
    return {"record_id": "<urn:uuid:1>", "type": "response", "target_uri": "http://h/x", "date": "2024-01-01T00:00:00Z", "refers_to": None, "payload_digest": None,
            "block_digest": None, "content_type": "application/http; msgtype=response", "headers": [("WARC-IP-Address", "1.2.3.4")], "block": block} | more


def test_derivatives_of_encoded_pages():
    body = PAGE.encode("latin-1")
    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX-Long: a\r\n b\r\n"
    forms = [plain + b"\r\n" + body,
             plain + b"Content-Encoding: gzip\r\n\r\n" + gzip.compress(body), plain + b"Content-Encoding: deflate\r\n\r\n" + zlib.compress(body),
             plain + b"Transfer-Encoding: chunked\r\n\r\n" + b"".join(b"%x\r\n%s\r\n" % (len(body[i:i + 50]), body[i:i + 50]) for i in range(0, len(body), 50)) + b"0\r\n\r\n"]
    for form in forms:
        meta, text = warc.derive(response(form))
        assert text["block"].decode() == warc.page_text(PAGE) and text["refers_to"] == meta["refers_to"] == "<urn:uuid:1>"
        fields = [line.split(": ", 1) for line in meta["block"].decode().strip().split("\r\n")]
        found = dict(fields)
        assert found["title"] == "A & B" and found["language"] == "de" and found["outlink"] == "/x?a=1&b=2" and found["source-status"] == "HTTP/1.1 200 OK"
        assert found["source-header-x-long"] == "a b" and dict(text["headers"])["WARC-IP-Address"] == "1.2.3.4"
        payload = form.partition(b"\r\n\r\n")[2]
        assert found["source-payload-digest"] == warc.digest(payload) == dict(meta["headers"])["WARC-Source-Payload-Digest"]
        assert meta["block_digest"] == warc.digest(meta["block"])


def test_files_round_trip(spark, tmp_path):
    records = [response(b"HTTP/1.1 200 OK\r\n\r\n" + PAGE.encode()), response(b"", record_id="<urn:uuid:2>", type="warcinfo"), response(b"\r\n\r\nWARC/1.1\r\n", record_id="<urn:uuid:3>")]
    whole = b"".join(map(warc.write_record, records))
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.write_record(r)) for r in records))
    (tmp_path / "c.warc").write_bytes(whole[:-30])
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.warc.gz").write_bytes(gzip.compress(warc.write_record(records[0])) + gzip.compress(warc.write_record(records[1]))[:-40])
    (tmp_path / "f.warc").write_bytes(b"WARC/1.1\r\nContent-Length: x\r\n\r\n")
    read = warc.parse(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted(r.record_id[-2] for r in read) == list("111122233")
    assert {(r.record_id, bytes(r.block), tuple(r.headers.items())) for r in read} == {(r["record_id"], r["block"], tuple(r["headers"])) for r in records}
    made = warc.derivatives(warc.parse(spark.read.format("binaryFile").load(str(tmp_path / "a.warc"))))
    again = [x for r in warc.serialize(made).collect() for x in warc.read_records(bytes(r.warc))]
    assert sorted((x["record_id"], x["refers_to"], x["block"]) for x in again) == sorted((r.record_id, r.refers_to, bytes(r.block)) for r in made.collect())


def test_derivatives_of_the_table(spark, small):
    pages = table(spark, small, "pages").unionByName(spark.createDataFrame([(None, None, None), (-1, "u", ""), (-1, "u", "")], "page_id long, url string, html string"))
    source = warc.responses(pages)
    made = warc.derivatives(source.withColumn("extra", F.lit(1))).collect()
    by = {r.record_id: r for r in source.collect()}
    assert len(made) == 2 * pages.count() and {r.refers_to for r in made} == set(by)
    for r in made:
        origin = by[r.refers_to]
        assert (r.target_uri, r.date) == (origin.target_uri, origin.date) and r.headers["WARC-Source-Payload-Digest"] == origin.payload_digest
        if r.type == "conversion":
            assert bytes(r.block).decode() == warc.page_text(bytes(origin.block).decode().partition("\r\n\r\n")[2])
    assert warc.derivatives(source.limit(0)).count() == 0 and len({r.record_id for r in made}) == 2 * len(by)


# --- chat

@given(st.lists(st.sampled_from([*chat.CONTROL, *"<>/\\[]|s:0", "INST", "turn", "|>", "SYS"]), max_size=12).map("".join))
def test_escaping_is_reversible_and_leaves_no_control(text):
    made = chat.escape(text)
    assert chat.unescape(made) == text and not any(c in made for c in chat.CONTROL)
    role, body = chat.parse_piece(chat.TURN + made + chat.BODY + made + chat.STOP)
    assert (role, body) == (text, text)


def test_parts_become_placeholders(spark):
    parts = [("text", "see <|image:0|> ", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("audio", None, "b.wav", None, None, 1.01, None),
             ("text", None, None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 3), ("video", "later", None, None, None, None, None), ("image",) + (None,) * 6]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok</s>",) + (None,) * 5]), (2, 0, None, None)]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumn("piece", F.lit("x"))
    got = {(r.conv_id, r.turn): r for r in chat.format_messages(frame).collect()}
    first = got[1, 0]
    assert first.piece == "<|turn|>user<|body|>see <\\|image:0|> <|image:0|><|audio:1|><|document:2|>later<|image:3|><|end|>"
    assert [(a.place, a.type, a.ref, a.n_tokens) for a in first.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 26), (2, "document", "c.pdf", 2400), (3, "image", None, 1)]
    assert first.n_tokens == 2431 and (first.loss_start, first.loss_end) == (0, 0)
    answer = got[1, 1]
    assert chat.unescape(answer.piece[answer.loss_start:answer.loss_end]) == "ok</s>" and got[2, 0].piece == "<|turn|><|body|><|end|>"
    whole = {r.conv_id: r.text for r in chat.rendered(chat.format_messages(frame)).collect()}
    assert whole[1] == "<s>" + first.piece + answer.piece + "</s>"


def test_read_back_against_plain_version(spark):
    rows = [(c, t, ("user", "assistant", "system", None)[(t + c) % 4], ODD_TEXTS[(c + t) % len(ODD_TEXTS)]) for c in range(5) for t in range(c + 1)]
    rows += [(9, 0, "assistant", "same"), (9, 0, "assistant", "same"), (9, None, "assistant", "</s>\\"), (None, 1, "user", "x")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, loss_start int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_messages(chat.as_parts(frame))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        loss = "".join(t or "" for _, _, role, t in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == 7 + sum(len("<|turn|><|body|><|end|>") + len(chat.escape(role or "")) + len(chat.escape(t or "")) for _, _, role, t in own)
    assert len(got) == len({r[0] for r in rows}) and chat.read_back(chat.format_messages(chat.as_parts(frame.limit(0)))).count() == 0


# --- packing

def test_packing_is_whole_and_tight(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([rng.randint(1, 60), rng.randint(1, 400), rng.randint(1, 3000)])) for i in range(2000)]
    rows += [(5000, 0), (5001, None), (5002, -4), (None, 77), (3, 40), (3, 40), (6000, 1024 * 5), (6001, 100_000)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, n_tokens long, bin_id string, piece int")
    capacities = (256, 512, 1024)
    for group in (100_000, 300):
        got = packing.pack_documents(frame, capacities, group).collect()
        assert len({(r.bin_id, r.bin_offset) for r in got if r.length}) == sum(r.length > 0 for r in got)
        total, bins = {}, {}
        for r in got:
            total.setdefault(r.doc_id, []).append((r.start, r.length))
            if r.length:
                bins.setdefault((r.bin_id, r.bin_length), []).append((r.bin_offset, r.length))
        for i, n in rows:
            if (n or 0) > 0 and i != 3:
                at = 0
                for start, length in sorted(total[i]):
                    assert start == at and length <= 1024
                    at += length
                assert at == n
        assert sum(length for _, length in total[3]) == sum(max(n or 0, 0) for i, n in rows if i == 3)
        assert all(total[i] == [(0, 0)] for i in (5000, 5001, 5002))
        assert len({b for b, _ in bins}) == len(bins)
        for (_, size), pieces in bins.items():
            at = 0
            for start, length in sorted(pieces):
                assert start == at
                at += length
            assert at <= size and size == min(c for c in capacities if c >= at)
        used = sum(max(n or 0, 0) for _, n in rows)
        assert sum(size for _, size in bins) <= 1.1 * used
    assert packing.pack_documents(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_by_definition(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, 100) for _ in range(80)), reverse=True)
    capacities = (40, 64, 100)
    bins, held = packing.fill(lengths, capacities, False)
    spaces = []
    for length, to in zip(lengths, bins):
        fitting = [(s, i) for i, s in enumerate(spaces) if s >= length]
        if fitting:
            assert min(fitting) == (spaces[to], to)
            spaces[to] -= length
        else:
            assert to == len(spaces)
            spaces.append(min(c for c in capacities if c >= length) - length)
    chosen, sizes = packing.pack(lengths, capacities)
    assert sum(map(packing.cost, sizes)) <= sum(map(packing.cost, packing.downsized(held, capacities)))
    assert packing.pack([]) == ([], [])
