"""The training-data operators against brute force, round trips and held-out accuracy, and at the edges."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from cohortline.llm import fingerprints, language, licenses, media, mixing, packing, quality, queries, resemblance, simhash, substrings, tokens

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, fingerprint string, size long, component_id long, "
           "row string, rank long, class string, spans string")
LONG = " ".join(f"w{k % 977} x{k * k % 5003}" for k in range(15_000))
LINE = " ".join(f"line{k}" for k in range(40))
TEXTS = [None, "", " \t\n", "one", "Eins zwei drei.", "Eins zwei drei.", LONG, LINE, "before " + LINE + " after  it", "la la " * 60,
         "This is cc by cc by work. ALL RIGHTS reserved, GNU General Public License v2!", "naïve ÀÉ ß ſ 中文 <|endoftext|> don't"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, [None, "de", "en"][k % 3], [None, "b", "a"][k % 3], 7, "x", 1, 2, "r", 3, "c", "s") for k, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id at all", "en", "a", None, None, None, None, None, None, None, None), (50, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, 0), (6, 1, 0), (7, 1, None), (8, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def documents(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


def runs(labels):
    return {
        "op1": fingerprints.edited_pairs, "op2": lambda d: simhash.near_duplicates(d, size=4), "op3": lambda d: tokens.token_counts(d, queries.vocabulary()),
        "op4": language.identify, "op5": mixing.mix_plan, "op5 rows": mixing.mixed, "op6": substrings.removed, "op6 rows": substrings.cleaned,
        "op7": lambda d: packing.pack(d, queries.vocabulary()), "op8": lambda d: quality.classify(d, labels), "op8 rows": lambda d: quality.accepted(d, labels),
        "op9": media.documents_as_media, "op10": licenses.license_scan, "op2 rows": simhash.survivors,
    }


@pytest.mark.parametrize("name", list(runs(None)))
def test_edges_and_empty_table(odd, labels, name):
    run = runs(labels)[name]
    found = run(odd)
    rows = found.collect()
    if name in ("op1", "op2", "op3", "op4", "op5", "op6", "op8", "op9", "op10"):
        assert len(rows) == odd.count()  # null ids and repeated rows stay
    if name.endswith("rows"):
        assert found.columns == odd.columns
    if name in ("op6 rows", "op8 rows"):
        assert sum(r["text"] is None for r in rows) == 2
    assert run(odd.limit(0)).collect() == []


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_fingerprints_of_edited_texts(spark, sf_dir, documents):
    found = by_id(queries.op1_fingerprints(spark, sf_dir))
    order = sorted(documents, reverse=True)
    for k, (doc, text, _, _) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        changed = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        r = found[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        a, b = fingerprints.sketch(text.encode()), fingerprints.sketch(changed.encode())
        assert r["fingerprint"] == fingerprints.as_text(a) and r["near_edited"] == fingerprints.resemblance(a, b)

        def shingles(t):
            w = t.split()
            return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

        x, y = shingles(text), shingles(changed)
        assert abs(r["near_edited"] - (len(x & y) / len(x | y) if x | y else 1)) < 0.2
    assert fingerprints.resemblance(fingerprints.EMPTY, fingerprints.EMPTY) == 1


def test_sketches_merge(spark):
    w = [f"a{k}".encode() for k in range(3000)]
    parts = [b" ".join(w[k:k + 504]) for k in range(0, 3000, 500)]
    whole = fingerprints.as_text(fingerprints.sketch(b" ".join(w)))
    rows = spark.createDataFrame([("g", fingerprints.as_text(fingerprints.sketch(p))) for p in parts] + [("h", None)], "g string, fingerprint string")
    assert dict(fingerprints.merged(rows, "g").collect()) == {"g": whole, "h": ""}
    assert abs(fingerprints.distinct_shingles(fingerprints.from_text(whole)) / 2996 - 1) < 0.3


def reachable(prints: dict[int, int], radius: int) -> dict[int, int]:
    root = {d: d for d in prints}
    for a in sorted(prints):
        for b in prints:
            if a < b and ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= radius and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def test_simhash_against_all_pairs(spark, sf_dir, documents):
    found = by_id(queries.op2_simhash(spark, sf_dir))
    want = {}
    for doc, text, _, _ in documents:
        w = text.encode().translate(simhash.UPPER).split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        want[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert {d: r["fingerprint"] for d, r in found.items()} == {d: f"{x:016x}" for d, x in want.items()}
    assert {d: r["component_id"] for d, r in found.items()} == reachable(want, 4)


@pytest.mark.parametrize("piece", [4096, 8])
def test_near_prints_in_whole_and_cut_groups(spark, piece):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**64, 12, dtype=np.uint64)
    near = {int(b) ^ sum(1 << int(x) for x in draw.choice(64, draw.integers(0, 7), replace=False)) for b in base for _ in range(25)}
    prints = {k: x for k, x in enumerate(sorted(near))}
    rows = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in prints.values()], "print long")
    links = [tuple(r) for r in simhash.links(rows, piece=piece).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
    place = {(x - 2**64 if x >> 63 else x): k for k, x in prints.items()}
    root = {k: k for k in prints}
    for a, b in links:
        low, high = sorted((root[place[a]], root[place[b]]))
        root = {d: low if r == high else r for d, r in root.items()}
    assert root == reachable(prints, 4)


def likeness(texts: dict[int, str]) -> dict[int, int]:
    """The smallest id reachable over all pairs of Jaccard 0.8 or more, from whole sets of five-word shingles."""
    sets = {}
    for doc, text in texts.items():
        w = text.encode().translate(simhash.UPPER).split()
        sets[doc] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if (not x and not y or x and y and 9 * len(x & y) >= 4 * (len(x) + len(y))) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


@pytest.mark.parametrize("sample", [5, 20_000])
def test_near_copies_against_all_pairs(spark, documents, sample):
    """Edited copies on both sides of 0.8, chains of copies, a line that many share, short and empty texts."""
    rng = np.random.default_rng(5)
    texts = {d: t or "" for d, t, _, _ in documents[:120]}
    long = [t for t in texts.values() if len(t.split()) > 60][:12]
    for k, text in enumerate(long):
        for edits in range(1, 15):
            w = text.split()
            for at in rng.choice(len(w), min(edits * len(w) // 150 + 1, len(w) // 3), replace=False):
                w[at] = f"other{k}x{edits}x{at}"
            texts[10_000 + 100 * k + edits] = " ".join(w)
            texts[20_000 + 100 * k + edits] = "one line that very many of these texts have in front " + " ".join(w[: 20 + 2 * edits])
    texts |= {30_000: "", 30_001: " ", 30_002: "a b", 30_003: "A  b", 30_004: "a b c"}
    expected = likeness(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in resemblance.near_copies(docs, sample=sample).collect()}
    assert found == expected
    prints = {d: simhash.fingerprint(t.encode(), 5) for d, t in texts.items()}
    assert len(set(expected.values())) != len(set(reachable(prints, 8).values()))  # eight bits of 64 don't tell it
    kept = {r["doc_id"] for r in resemblance.survivors(docs).collect()}
    assert kept == set(expected.values())


def test_near_copies_go_through_the_simhash_ring(spark, sf_dir, monkeypatch):
    """The pipeline's stage links prints by op2's ring first; what the ring proposes is confirmed, what it misses is found."""
    import corpus_pipeline

    base = [f"w{x}" for x in np.random.default_rng(4).integers(0, 5000, 400)]
    rows = [(k, " ".join([*base[:200 + k], "changed", *base[201 + k:]])) for k in range(30)] + [(90, "something else"), (91, None), (92, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = []
    monkeypatch.setattr(resemblance, "links", lambda prints, *a: asked.append({r["print"] for r in prints.collect()}) or simhash.links(prints, *a))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert asked == [{simhash.fingerprint((t or "").encode(), 5) for _, t in rows}]
    assert kept == {0, 90, 91}
    # a ring that links all or nothing moves costs, never results
    for ring in (lambda p, *a: p.toDF("a").crossJoin(p.toDF("b")).where("a < b"), lambda p, *a: p.selectExpr("print AS a", "print AS b").limit(0)):
        monkeypatch.setattr(resemblance, "links", ring)
        assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()} == kept


def test_the_ring_of_the_pipeline_reaches_eight_bits(spark, sf_dir, monkeypatch):
    """Copies of likeness 0.8 or more whose fingerprints are 5 to 8 bits apart are proposed by the ring, not by shingles alone."""
    import corpus_pipeline

    rng, pairs = np.random.default_rng(12), []
    while len(pairs) < 6:
        w = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        other = list(w)
        for at in rng.choice(200, 3, replace=False):
            other[at] = "changed"
        texts = " ".join(w), " ".join(other)
        a, b = (simhash.fingerprint(t.encode(), 5) for t in texts)
        if 5 <= ((a ^ b) & (2**64 - 1)).bit_count() <= 8 and len(set(likeness(dict(enumerate(texts))).values())) == 1:
            pairs.append(texts)
    docs = spark.createDataFrame([(2 * k + n, t) for k, p in enumerate(pairs) for n, t in enumerate(p)], "doc_id long, text string")
    linked, proposed = resemblance.linked, set()

    def noted(nodes, sets, least, likeliest):
        proposed.update((r["a"], r["b"]) for r in likeliest.collect())
        return linked(nodes, sets, least, likeliest)

    monkeypatch.setattr(resemblance, "linked", noted)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert proposed >= {tuple(sorted(resemblance.named(resemblance.shingles(t.encode(), 5)) for t in p)) for p in pairs}
    assert kept == set(range(0, 12, 2))


@pytest.mark.parametrize("piece", [4096, 8])
def test_ring_of_ten_segments_against_all_pairs(spark, piece):
    draw = np.random.default_rng(6)
    base = draw.integers(0, 2**64, 10, dtype=np.uint64)
    prints = sorted({int(b) ^ sum(1 << int(x) for x in draw.choice(64, draw.integers(0, 10), replace=False)) for b in base for _ in range(20)})
    signed = [x - 2**64 if x >> 63 else x for x in prints]
    links = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "print long"), 8, 10, piece).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 8 for a, b in links)
    root = {k: k for k in range(len(prints))}
    for a, b in links:
        low, high = sorted((root[signed.index(a)], root[signed.index(b)]))
        root = {d: low if r == high else r for d, r in root.items()}
    assert root == reachable(dict(enumerate(prints)), 8)


def test_pipeline_removes_near_copies_at_the_stated_likeness(spark, sf_dir):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    rows = []
    for k in range(40):  # 6 or 13 of 300 words changed: likeness 0.82 or 0.64
        w = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((2 * k, " ".join(w)))
        for at in range(10, 290, 47 if k % 2 else 23):
            w[at] = "changed"
        rows.append((2 * k + 1, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert kept == set(likeness(dict(rows)).values()) and len(kept) < 80


def test_tokens_as_the_library_has_them(spark, sf_dir, documents, odd):
    library = tokens.load(queries.vocabulary())
    found = by_id(queries.op3_token_counts(spark, sf_dir))
    for doc, text, _, _ in documents:
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (found[doc]["n_tokens"], found[doc]["n_bytes"], found[doc]["over_limit"]) == (n, len(text.encode()), n > 2048)
    count, ids = tokens.counter(queries.vocabulary(), tokens.whole_tokens(queries.vocabulary())), tokens.encoder(queries.vocabulary())
    for text in [t for t in TEXTS if t] + ["ßC Ⱥ İ ǅ é ÀB 'RE x's <|ENDOFTEXT|>", " 　\x85\x1c", "🙂a"]:
        want = library.encode(text, add_special_tokens=False).ids
        assert count(text.encode()) == len(want) and np.frombuffer(ids(text.encode()), "<u4").tolist() == want


def test_language_on_held_out_documents(spark, sf_dir, documents):
    found = by_id(queries.op4_language(spark, sf_dir))
    held = [(found[d]["lang_pred"], lang) for d, _, lang, _ in documents if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for d, r in found.items())


def test_mix_targets(odd):
    rows = mixing.mix_plan(odd).collect()
    assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in rows)
    assert [r["taken"] for r in sorted(rows, key=str)] == [r["taken"] for r in sorted(mixing.mix_plan(odd).collect(), key=str)]


def removed_words(texts: list[str | None]) -> list[list[int]]:
    parts = [(t or "").encode().split() for t in texts]
    seen: dict = {}
    for w in parts:
        for i in range(len(w) - 34):
            key = b" ".join(w[i:i + 35])
            seen[key] = seen.get(key, 0) + 1
    return [sorted({j for i in range(len(w) - 34) if seen[b" ".join(w[i:i + 35])] > 1 for j in range(i, i + 35)}) for w in parts]


def test_substrings_against_brute_force(odd):
    rows = odd.select("doc_id", "text").collect()
    want = []
    for r, gone in zip(rows, removed_words([r["text"] for r in rows]), strict=True):
        w = (r["text"] or "").encode().split()
        kept = [x for k, x in enumerate(w) if k not in set(gone)]
        want.append((str(r["doc_id"]), len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in substrings.removed(odd, shard=8, stream=50, filter_bits=12).collect()) == sorted(want)


def test_automaton():
    a = substrings.Automaton()
    a.add(b"a b c d a b".split())
    a.add(b"b c x".split())
    assert a.matches(b"z a b c x q d a b".split(), 2) == [1, 5, 6, 9]


def test_packing(spark, sf_dir, documents):
    library, rows = tokens.load(queries.vocabulary()), queries.op7_packing(spark, sf_dir).collect()
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t, _, _ in documents}
    pieces: dict = {}
    sequences: dict = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    gapless = lambda spans: [a for a, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1].tolist()]
    assert all(gapless(x) and sum(n for _, n in x) == len(ids[d]) for d, x in pieces.items()) and set(pieces) == set(ids)
    used = [sum(n for _, n in x) for x in sequences.values()]
    assert all(map(gapless, sequences.values())) and max(used) <= 2048
    padding = sum(0 if u & (u - 1) == 0 else 2048 - u for u in used)
    assert padding < 0.05 * sum(used)


def test_pattern_plans():
    draw = np.random.default_rng(5)
    for sizes in (draw.integers(1, 257, 4000), draw.integers(1, 40, 500), np.full(7, 256)):
        demand = np.bincount(sizes, minlength=257)[1:]
        used = packing.plan(demand, 256)
        assert (sum(c * n for c, n in used) == demand).all() and all(c @ np.arange(1, 257) <= 256 for c, _ in used)
        assert sum(n for _, n in used) <= 1.02 * sizes.sum() / 256 + 1
    assert packing.plan(np.zeros(256, np.int64), 256) == []


def test_quality_keeps_the_clean(spark, sf_dir):
    found = by_id(queries.op8_quality(spark, sf_dir))
    told = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{sf_dir}/labels.parquet'").fetchall()
    clean, poor = [found[d]["kept"] for d, q, t in told if q == 1 and t == 0], [found[d]["kept"] for d, q, _ in told if q == 0]
    assert np.mean(clean) >= 0.97 and np.mean(poor) < 0.5


class KneserNey:
    """The model by the book, from words with their counts: continuation counts, discounts, interpolation."""

    def __init__(self, counts: dict[str, int], order: int = quality.ORDER):
        raw: dict = {}
        for word, n in counts.items():
            marked = "\x02" + word + "\x03"
            for end in range(2, len(marked) + 1):
                for size in range(1, min(order, end) + 1):
                    raw[marked[end - size:end]] = raw.get(marked[end - size:end], 0) + n
        before: dict = {}
        for gram in raw:
            before.setdefault(gram[1:], set()).add(gram[0])
        self.n = {g: n if len(g) == order or g[0] == "\x02" else len(before[g]) for g, n in raw.items()}
        self.off = {}
        for size in range(1, order + 1):
            n1, n2, n3, n4 = (sum(1 for g, n in self.n.items() if len(g) == size and n == k) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            found = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.25, 2 - 3 * y * n3 / n2 if n2 and n3 else 0.75, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.25]
            self.off[size] = [min(max(d, 0.05), k + 0.95) for k, d in enumerate(found)]
        self.under: dict = {}
        for g, n in self.n.items():
            self.under.setdefault(g[:-1], []).append(n)
        self.order = order

    def probability(self, gram: str) -> float:
        if not gram:
            return 1 / (1 + sum(1 for g in self.n if len(g) == 1))
        seen = self.under.get(gram[:-1])
        if not seen:
            return self.probability(gram[1:]) if len(gram) > 1 else 1.0
        off = self.off[len(gram)]
        own, total, rest = self.n.get(gram, 0), sum(seen), sum(off[min(n, 3) - 1] for n in seen)
        return (max(own - off[min(own, 3) - 1], 0) if own else 0) / total + rest / total * self.probability(gram[1:])

    def cost(self, text: str) -> tuple[float, int]:
        grams = [g for w in text.split() for g in quality.grams_of(w, self.order)]
        return -sum(np.log(self.probability(g)) for g in grams), len(grams)


TRUSTED = ["the cat sat on the mat the end", "a cat and a hat", None, "", "the thin thing thought that this then there"]


@pytest.fixture(scope="module")
def learned(spark):
    return quality.model(spark.createDataFrame([(t,) for t in TRUSTED], "text string"))


def book():
    counts: dict = {}
    for word in " ".join(t or "" for t in TRUSTED).split():
        counts[word] = counts.get(word, 0) + 1
    return KneserNey(counts)


def test_model_probabilities_sum_to_one(spark, learned):
    own, _ = learned
    symbols = [r["gram"] for r in own.where("length = 1").collect()] + ["Q"]
    contexts = ["", "\x02", "\x02t", "ca", "\x02the", "zz"]
    asked = spark.createDataFrame([(c + s,) for c in contexts for s in symbols], "gram string")
    found = dict(quality.probabilities(asked, *learned).collect())
    by_book = book()
    for c in contexts:
        assert abs(sum(found[c + s] for s in symbols) - 1) < 1e-9
        assert all(abs(found[c + s] - by_book.probability(c + s)) < 1e-9 for s in symbols)


def test_spread_of_words_into_ngrams():
    pieces = ["a", "the", "then", "中文字", "".join(map(chr, range(0x3400, 0x3400 + 6000))), "the"]
    want: dict = {}
    for piece, n in zip(pieces, range(1, 7), strict=True):
        for gram in quality.grams_of(piece, 5):
            want[gram] = want.get(gram, 0) + n
    for some in (pieces, [*pieces, "".join(map(chr, range(0x10000, 0x13000)))]):
        found = list(quality.spread_grams(some, list(range(1, len(some) + 1)), 5))
        assert len(dict(found)) == len(found) and want.items() <= dict(found).items()


def test_most_used_ngrams_are_chosen_without_a_sort(spark):
    """The chosen rows alone go to the driver: a limit over an order sends as many rows from each task."""
    rows = spark.createDataFrame([(f"g{k}", 1 + 10_000 // (k + 1) if k < 2000 else 1) for k in range(6000)], "gram string, uses long")
    for most in (0, 50, 1000, 4000, 6000, 9000):
        found = quality.most_used(rows, most)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "Sort" not in plan
        uses = sorted((r["uses"] for r in found.collect()), reverse=True)
        assert abs(len(uses) - min(most, 6000)) <= max(0.1 * most, 8) * (0 < most < 6000)
        every = sorted((r["uses"] for r in rows.collect()), reverse=True)
        sure = every[: int(most * 0.8)]
        assert uses[: len(sure)] == sure


def test_word_costs_are_those_of_the_words_ngrams():
    words = ["a", "ab", "abc", "abcd", "abcdef", "\u00e9t\u00e9s", "", "x\x02y", "\x00", "long" * 40]
    grams = sorted({g for w in words for p in quality.pieces_of(w.encode()) for g in quality.grams_of(p, 5)})
    for held in ({g: k + 1 for k, g in enumerate(grams)}, {g: k + 1 for k, g in enumerate(grams) if k % 3}):
        scorer = quality.Scorer(held)
        for w in words:
            whole = [g for p in quality.pieces_of(w.encode()) for g in quality.grams_of(p, 5)]
            value, rare = scorer.parts(w.encode())
            assert (value.real, value.imag, sorted(rare)) == (sum(held.get(g, 0) for g in whole), len(whole), sorted(g for g in whole if g not in held))


@pytest.mark.parametrize("most_held", [0, 7, 200_000])
def test_costs_by_join_and_by_held_ngrams(spark, learned, most_held):
    texts = [*TRUSTED, "the cat", "the cat", "zebra Q the the the", "x" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_book = book()
    rows = quality.scores(docs, *learned, [docs["doc_id"]], most_held=most_held).collect()
    assert len(rows) == len(texts)
    for r in rows:
        cost, symbols = by_book.cost(texts[r["doc_id"]] or "")
        assert r["symbols"] == symbols and abs(r["nll"] - cost) <= 1e-6 * (symbols + 1)


def test_media_round_trip(spark, sf_dir, documents):
    found = by_id(queries.op9_media(spark, sf_dir))
    for doc, text, _, _ in documents:
        raw = text.encode()
        size = max(1, -(-len(raw) // 576)) * 576
        raw += b"\xff" * (size - len(raw))
        r = found[doc]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (size, hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
        assert media.samples(b"P5\n576 %d\n255\n" % (size // 576) + raw) == raw and r["n_bytes"] == len(text.encode())


def test_html_items_stay_in_order(spark):
    digest = "ab" * 32
    html = f"<p>one <b>two</b></p><figure><img src='media/{digest}' alt='x'><figcaption>said</figcaption></figure><script>no</script>three<img src='y.png'>"
    assert [x[1:] for x in media.parse(html)] == [
        ("text", "one two", None, None, None), ("image", None, f"media/{digest}", digest, "said"), ("text", "three", None, None, None), ("image", None, "y.png", None, None)]
    assert media.parse(None) == media.parse("") == []
    pages = spark.createDataFrame([(1, html, "k"), (2, None, "k")], "page_id long, html string, digest string")
    store = spark.createDataFrame([(digest, bytearray(b"P5\n576 1\n255\n" + b"a" * 576))], "digest string, media binary")
    (row,) = media.media_sequences(pages, store).collect()
    assert [i["media_bytes"] for i in row["items"]] == [None, 589, None, None] and [i["position"] for i in row["items"]] == [0, 1, 2, 3]


def test_license_places(spark, sf_dir, documents, odd):
    import re

    phrases = {tuple(p.split()): label for p, label in licenses.BASE}
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect() if r["doc_id"] not in (None, 4)] + [(1000 + d, t) for d, t, _, _ in documents]
    found = by_id(licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    for doc, text in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
        places = [(i, label) for i in range(len(w)) for p, label in phrases.items() if tuple(w[i:i + len(p)]) == p]
        r = found[doc]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert len(licenses.rules()) > 200


def test_inner_license_matches_are_dropped(spark):
    rows = spark.createDataFrame([(1, "GNU Lesser General Public License version 2.1 or later")], "doc_id long, text string")
    (row,) = licenses.license_scan(rows).collect()
    assert "lgpl-2.1" in row["labels"] and not any(d["label"] == "lgpl" for d in row["found"])


def spelled(pattern: str) -> list[str]:
    """Texts that match the pattern and between them take every alternative, each option both ways."""
    from itertools import product
    from re import _parser as parser

    def each(parsed) -> list[str]:
        return ["".join(x) for x in product(*(one(*item) for item in parsed))]

    def one(kind, value) -> list[str]:
        kind = str(kind)
        if kind == "LITERAL":
            return [chr(value)]
        if kind == "ANY":
            return [" "]  # what follows begins a word
        if kind == "IN":
            return [chr(c) for k, v in value for c in ([v] if str(k) == "LITERAL" else [v[0]])]
        if kind == "BRANCH":
            return [x for branch in value[1] for x in each(branch)]
        if kind == "SUBPATTERN":
            return each(value[-1])
        assert kind == "MAX_REPEAT", kind
        low, _, inner = value
        found = each(inner)
        return [f * low for f in found] + [f * (low + 1) for f in found]

    return sorted(set(each(parser.parse(pattern))))


def test_license_rules_hold_their_keywords(spark):
    import re

    listed = licenses.rules()
    for r in listed:
        for text in spelled(r.pattern):
            if re.fullmatch(r.pattern, text):
                assert any(f" {k}" in f" {text} " for k in r.keywords), (r, text)
    rows = ["This may not be copied.", "It must not be reproduced", "under the terms of this licence", "See COPYING for more details", "see the licence file for details"]
    found = by_id(licenses.license_scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    assert [(found[k]["labels"], found[k]["score"]) for k in range(5)] == [("reserved", 0.5)] * 2 + [("reference", 0.5)] * 3


def test_pipeline_stages(spark, sf_dir, documents):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "mixing", "packing"]
    from cohortline.session import scratch_path

    for name, stage in corpus_pipeline.STAGES:
        out = scratch_path(spark, f"stage_{name}")
        before = [r["text"] for r in docs.select("text").collect()] if name == "substrings" else None
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs.count()
        assert name == "packing" or docs.columns == names
        if name == "near_duplicates":
            prints = {r["doc_id"]: simhash.fingerprint(r["text"].encode(), 5) for r in docs.collect()}
            assert len(set(reachable(prints, 8).values())) == len(prints)
        if name == "substrings":
            lost = sum(map(len, removed_words(before)))
            assert sum(len(r["text"].split()) for r in docs.collect()) == sum(len(t.split()) for t in before) - lost
    assert seen["quality"] >= seen["near_duplicates"] == seen["substrings"] > 0 and seen["packing"] >= seen["mixing"] > 0


def test_long_words_lose_no_ngrams(spark):
    from collections import Counter

    for word in ("ab", "x" * 63, "x" * 64, "y" * 65, "".join(map(chr, range(33, 127))) * 5, "äö" * 100, "abc" * 21 + "q", "z" * 129):
        whole = quality.START + word + quality.END
        want = Counter(whole[max(0, k - 4):k + 1] for k in range(1, len(whole)))
        pieces = quality.pieces_of(word.encode())
        spread: Counter = Counter()
        for gram, n in quality.spread_grams(pieces, [1] * len(pieces), 5):
            spread[gram] += n
        assert want == Counter(g for p in pieces for g in quality.grams_of(p, 5)) == spread
        counted = quality.ngram_counts(quality.word_counts(spark.createDataFrame([(word.encode(),)], "text binary")))
        assert {r["gram"]: r["n"] for r in counted.where("length = 5").collect()} == {g: n for g, n in want.items() if len(g) == 5}


def test_memo_is_bounded_and_keeps_what_is_used():
    from cohortline.llm.common import Memo

    asked = []
    held = Memo(lambda k: asked.append(k) or k * 2, limit=10, room=1000)
    for k in range(200):
        assert held["hot"] == "hothot" and held[f"w{k}"] == f"w{k}w{k}"
    assert asked.count("hot") == 1 and len(held) + len(held.older) <= 20
    for k in range(50):
        held["x" * 100 + str(k)]
    assert sum(map(len, [*held, *held.older])) <= 2 * 1000


def test_survivors_with_clashing_columns(spark, labels):
    rows = [(1, "one two three four five six seven", "en"), (2, "one two three four five six seven", "en"), (3, None, None), (4, "the cat sat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS _gone", "2 AS __gone", "3 AS `_Id`", "4 AS component_id")
    for kept in (resemblance.survivors(docs, size=5), simhash.survivors(docs)):
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.where("text IS NULL").count() == 1
