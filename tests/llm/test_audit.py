"""Personal data, Merkle manifest and prefix trie against plain Python, the manifest and the trie also against SQL."""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from collections import defaultdict

import duckdb
import pytest

from cohortline.llm import merkle, pii, prefixes, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base_spans(text: str) -> list[tuple]:
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            small = kind != "ip" or all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))
            if {"email": True, "ip": small, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def told(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def check_base(row, text: str) -> None:
    want = base_spans(text)
    assert row["base_sha256"] == hashlib.sha256(told(want).encode()).hexdigest()
    assert [row[f"n_{k}"] for k in BASE] == [sum(s[3] == k for s in want) for k in BASE]


def test_base_kinds_of_documents(spark, sf_dir):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    rows = queries.op11_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r["spans"] for r in rows)
    for r in rows:
        check_base(r, texts[r["doc_id"]] or "")


ODD = [
    None, "", "x@y.z a@b.c_d@e.f 𝒳 +1 (212) 555-1234 4111 1111 1111 1111 at 1.2.3.256 000255.1.1.1 08.09.1.0", "a@b a@b.c.@d.e..f " * 50,
    "+1 2 3 4 5 6 7 8 9 0 +12345678901234567 ++1-2-3 +4(5)6.7 8901234", "1.2.3.4.5.6.7.8 1..2 4111-1111-1111-1111-1 " * 400, "ä@ö.de %@-.- 5555555555554444,4012888888881881",
]


def test_base_kinds_at_the_edges(spark):
    docs = spark.createDataFrame([*enumerate(ODD), (None, ODD[2]), (2, ODD[2])], "doc_id long, text string").selectExpr("*", "1 AS found", "'s' AS spans", "2 AS _text")
    rows = pii.pii_scan(docs).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        check_base(r, (ODD[r["doc_id"]] or "") if r["doc_id"] is not None else ODD[2])
        assert all(0 <= f["start"] < f["end"] and 0 <= f["score"] <= 1 for f in r["found"])
    assert pii.pii_scan(docs.limit(0)).collect() == []


def test_long_runs_are_passed_once(spark):
    """Texts on which trying every start of a run, or a stack frame per character, would not end."""
    long = {0: "9" * 200_000, 1: "a" * 200_000, 2: "a" * 100_000 + "@" + "b" * 100_000, 3: "1 " * 100_000, 4: "1.2.3." * 40_000, 5: "+1 " * 70_000}
    rows = {r["doc_id"]: r for r in pii.pii_scan(spark.createDataFrame(list(long.items()), "doc_id long, text string")).collect()}
    assert [rows[k]["spans"] for k in (0, 1, 2, 3)] == [""] * 4
    assert rows[4]["n_ip"] == len(re.findall(BASE["ip"], long[4])) and rows[5]["n_phone"] == 0


def test_kinds_of_the_method_and_scores(spark):
    cases = [
        ("IBAN DE89 3704 0044 0532 0130 00 please", ["iban:5:32"], 1.0), ("pay GB82WEST12345698765432 now", ["iban:4:26"], 0.8), ("DE89370400440532013001", [], 0.0),
        ("NO9386011117947", ["iban:0:15"], 0.8), ("social security 123-45-6789", ["ssn:16:27"], 0.7), ("code 123-45-6789", [], 0.0), ("ssn 000-45-6789", [], 0.0),
        ("bank transit 021000021", ["routing:13:22"], 0.6), ("routing 021000022", [], 0.0), ("id 021000021", [], 0.0),
        ('token = "abcdef0123456789abcdef"', ["secret:9:31"], 0.6), ("word abcdef0123456789abcdef", [], 0.0), ("password: aaaaaaaaaaaaaaaaaaaa", [], 0.0),
        ("visa card 4111111111111111", ["card:10:26"], 1.0), ("4111111111111111", ["card:0:16"], 0.6), ("order 4111111111111111", ["card:6:22"], 0.2),
        ("version 10.1.2.3", ["ip:8:16"], 0.2), ("call +49 30 1234567", ["phone:5:19"], 1.0), ("e-mail to a@b.example", ["email:10:21"], 1.0),
    ]
    docs = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.pii_scan(docs).collect()}
    for k, (text, spans, score) in enumerate(cases):
        assert (rows[k]["spans"], rows[k]["score"]) == (",".join(spans), score), text


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes: list[str]) -> list[list[str]]:
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h("".join(found[-1][k:k + 8])) for k in range(0, len(found[-1]), 8)])
    return found


def by_book(docs) -> list[tuple]:
    rows, low = [], str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for doc, text, lang, source, n_chars in docs:
        leaf = lambda t: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, t)))  # noqa: E731, B023
        changed = text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        rows.append((lang, doc, leaf(text), leaf(text.translate(low) if changed else text)))
    rows.sort(key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    trees = [levels([r[2] for r in g]) for g in groups.values()]
    top, found = levels([t[-1][0] for t in trees]), []
    for at, (tree, group) in enumerate(zip(trees, groups.values(), strict=True)):
        for place, r in enumerate(group):
            proof, node = "", r[3]
            for whole, p in ((tree, place), (top, at)):
                for nodes in whole[:-1]:
                    run, k = nodes[p // 8 * 8:p // 8 * 8 + 8], p % 8
                    proof, node, p = proof + "".join(run[:k] + run[k + 1:]), h("".join([*run[:k], node, *run[k + 1:]])), p // 8
            found.append((r[1], r[2], tree[-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(found, key=str)


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


def view(sf_dir: str, name: str):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_manifest_of_documents(spark, sf_dir):
    con, found = view(sf_dir, "documents"), rows_of(queries.op12_merkle(spark, sf_dir))
    assert found == by_book(con.sql("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall())
    assert found == sorted(con.sql(queries.SQL["op12_merkle"]).fetchall(), key=str)
    assert 0 < sum(r[-1] for r in found) < len(found)


def test_manifest_at_the_edges(spark):
    """Null, negative, extreme and repeated ids, thousands of rows of one id, several blocks, one-leaf groups, clashing columns."""
    rows = [(k, f"T{k}", [None, "de", "", "z"][k % 4] if k > 3 else "lone", None, k) for k in range(-300, 200, 7)]
    rows += [(5, "Same", "x", "s", 1)] * 4500 + [(6, f"d{k}", "x", "s", 1) for k in range(1200)] + [(None, f"n{k % 3}", "x", None, None) for k in range(10)]
    rows += [(2**63 - 1, "A", None, None, None), (-(2**63), "B", None, None, None), (2**62, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS grp", "2 AS word", "3 AS rank", "4 AS id")
    assert rows_of(merkle.documents_manifest(docs)) == by_book(rows)
    assert merkle.documents_manifest(docs.limit(0)).collect() == []
    assert all(r["verified"] for r in merkle.manifest(docs.limit(40)).collect())


def trie_by_book(rows) -> list[tuple]:
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by[conv].append((turn is not None, turn or 0, h(f"{len(role.encode())}:{role}{text}")[:32], role, text))
    by = {c: [t[3:] for t in sorted(ts)] for c, ts in by.items()}
    whole, members, kids, leaves, saved = {}, defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, own in by.items():
        k = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(by.get(c - int(math.fmod(c, 100)), [])[:k] + own[k:])
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, held in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(held) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += not kids[node]
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n],
                    h(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(n)))))) for n, m in members.items()), key=str)


def test_trie_of_conversations(spark, sf_dir):
    con, found = view(sf_dir, "conversations"), rows_of(queries.op13_prefixes(spark, sf_dir))
    assert found == trie_by_book(con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall())
    assert found == sorted(con.sql(queries.SQL["op13_prefixes"]).fetchall(), key=str)


def test_trie_at_the_edges(spark):
    """Null turns, roles, texts and ids, tied and repeated turns, absent and turnless conversations, one with very many turns."""
    rows = [(c, t, "u" if t % 2 else None, ["a", "b", None, "ü𝒳", "long text"][(c * t) % 3 if t < 4 else t % 5]) for c in range(-120, 330) for t in range(c % 9)]
    rows += [(None, 1, "u", "x"), (7, None, "s", "sys"), (7, None, "s", "sys"), (7, 1, "s", "q"), (1000, 3, "u", "z"), (1001, 0, "u", "z"), (1002, 0, None, None), (40_001, 0, "u", "x")]
    kind = "conv_id long, turn int, role string, text string"
    talks = spark.createDataFrame(rows, kind).selectExpr("*", "1 AS depth", "2 AS a", "3 AS conv", "4 AS place")
    assert rows_of(prefixes.prefix_trie(talks)) == trie_by_book(rows)
    assert prefixes.prefix_trie(talks.limit(0)).collect() == []
    n, width = 9000, 3
    long = spark.createDataFrame([(2000 + 100 * c, t, "u", f"t{t}" if t < n - 5 or c == 0 else f"{c}") for c in range(width) for t in range(n)], kind)
    found = {(r["conv_id"], r["depth"]): r for r in prefixes.prefix_trie(long).collect()}
    shared = sum(len(f"t{t}") for t in range(n - 5))
    root = found[2000, 0]
    assert (root["n_convs"], root["n_leaves"], root["saved_tokens"], root["n_children"]) == (width, width, (width - 1) * shared, 1)
    assert len(found) == 1 + n - 5 + 5 * width and found[2000, n - 5]["n_children"] == width and found[2100, n]["n_leaves"] == 1


@pytest.mark.parametrize("count", [1, 5000])
def test_ends_of_one_sequence_by_lots(spark, count):
    talks = spark.createDataFrame([(1_000_000 + 100 * c, 0, "u", "same") for c in range(count)], "conv_id long, turn int, role string, text string")
    found = prefixes.prefix_trie(talks).where("depth = 1").collect()
    ids = [1_000_000 + 100 * c for c in range(count)]
    assert [(r["conv_id"], r["n_convs"], r["ends_sha256"]) for r in found] == [(ids[0], count, h(",".join(map(str, ids))))]
