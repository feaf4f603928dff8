"""Operators against plain versions, on the smallest tables and on made cases."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tripweave.llm import (decontaminate, embedding_dedup, language_id, line_dedup, links, packing,
                           pii, queries, simhash_dedup, token_counts, token_matrix, url_filter)
from tripweave.llm.tokens import Pieces

SF = "/root/testdata/sf0.001"
WORDS, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "\n", "  a  b   c ", "a \n b\n\nc \t d", "x <|endoftext|> y<|endoftext|>.", "tail ",
       "<|startoftext|>Hi", "E\u0301 \u00e9 a", "it's, don't. We'll...,", "1234.5, ½² ³. x²,",
       "\x1ca\x1c b\x85c \xa0 d", "ΑΣ. ΣΑΣ İstanbul", "日本語 テスト。 ok", "a" * 3000, " lead",
       "ab\u0301. é,", "Only one", "one"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def made(spark, texts, **extra):
    """Documents with repeated rows, null ids and a column of an awkward name."""
    data = [(None if i % 7 == 3 else i // 2, t, "en", f"s{i % 3}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, "
                                       "`__row` int")


CASES = ODD + [None, None, "one", "same text here", "same text here", "x " * 40_000]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]


@pytest.mark.parametrize("path", [WORDS, BYTES])
@pytest.mark.parametrize("direct", [True, False])
def test_pieces_are_the_librarys(path, direct):
    rng = random.Random(1)
    letters = list("aB é.,'s \n\t1²<|>\x1c\u0301日Σ") + ["<|endoftext|>", " ", "  "]
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(2000)]
    texts += [("word, " * 100_000)[:-1] + "  end", "b" * 70_000 + " c"]
    want = brute.token_ids(path, texts)
    got = Pieces(path, False, direct).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert Pieces(path, True, direct).encode(texts) == list(map(len, want))


def test_token_counts(spark, docs):
    want = [(i, len((t or "").encode()), len(ids), len(ids) > 512)
            for (i, t), ids in zip(docs, brute.token_ids(BYTES, [t for _, t in docs]))]
    assert rows(queries.op3_token_counts(spark, SF)) == sorted(want, key=repr)
    case = made(spark, CASES)
    got = rows(token_counts.count_tokens(case, BYTES))
    ids = [r["doc_id"] for r in case.collect()]
    want = [(i, len((t or "").encode()), len(n), len(n) > 512)
            for i, t, n in zip(ids, CASES, brute.token_ids(BYTES, CASES))]
    assert got == sorted(want, key=repr)
    assert rows(token_counts.count_tokens(case.limit(0), BYTES)) == []


def check_packing(pieces, want, length):
    """``want``: id -> the ids of its one row."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(want)
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            part = want[i][p["start"]:p["start"] + p["length"]]
            assert (p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) == (
                at, len(part), brute.crc(part), len(want[i]))
            at += len(part)
        assert at == len(want[i])
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length
    return sum(p["length"] for p in pieces) / (length * len(by_seq))


def test_packing(spark, docs):
    want = {i: ids + [2] for (i, _), ids in zip(docs, brute.token_ids(WORDS, [t for _, t in docs]))}
    assert check_packing(queries.op2_packing(spark, SF).collect(), want, 4096) > 0.97
    # Small groups: the same pieces, still gapless.
    few = packing.pack(table(spark, "documents"), WORDS, 64, 2, True, group_tokens=4000)
    got = few.collect()
    assert check_packing(got, want, 64) > 0.9
    assert len({p["sequence_id"] >> 32 for p in got}) > 20
    assert all(np.frombuffer(p["ids"], "<u4").tolist()
               == want[p["doc_id"]][p["start"]:p["start"] + p["length"]] for p in got)


def test_packing_cases(spark):
    case = made(spark, CASES)
    got = packing.pack(case, WORDS, 4096, 2).collect()
    want = [len(n) + 1 for n in brute.token_ids(WORDS, CASES)]
    assert sum(p["length"] for p in got) == sum(want)
    assert sorted(p["doc_tokens"] for p in got if p["start"] == 0) == sorted(want)
    assert packing.pack(case.limit(0), WORDS, 4096, 2).collect() == []


def test_first_and_best_fit():
    rng = random.Random(3)
    for _ in range(50):
        cap = rng.choice([10, 64, 100])
        sizes = sorted((rng.randint(1, cap) for _ in range(rng.randint(1, 80))), reverse=True)
        room, want = [], []
        for s in sizes:
            k = next((i for i, r in enumerate(room) if r >= s), len(room))
            if k == len(room):
                room.append(cap)
            want.append((k, cap - room[k]))
            room[k] -= s
        bins, offsets = packing.first_fit(sizes, cap)
        assert list(zip(bins.tolist(), offsets.tolist())) == want
        left = {}
        for s, b in zip(sizes, token_matrix.best_fit(sizes, cap).tolist()):
            fits = [r for r in left.values() if r >= s]
            assert left.get(b, cap) == (min(fits) if fits else cap)
            left[b] = left.get(b, cap) - s


def test_token_matrix_round_trip(spark, docs, tmp_path):
    want = {i: ids + [50256] for (i, _), ids in
            zip(docs, brute.token_ids(BYTES, [t for _, t in docs]))}
    got = {}
    token_matrix.write_matrix(queries.op9_token_matrix(spark, SF), f"{tmp_path}/m")
    for r in spark.read.parquet(f"{tmp_path}/m").collect():
        ids, positions = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2")
        assert len(ids) == len(positions) == 4096 and r["cu_seqlens"][0] == 0
        assert r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"]:] == 50256).all()
        for i, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            got.setdefault(i, {})[s] = ids[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
    assert {i: sum((p[s] for s in sorted(p)), []) for i, p in got.items()} == want
    case = made(spark, CASES)
    n = token_matrix.pack_matrix(case, BYTES, 4096).agg(F.sum("n_tokens")).first()[0]
    assert n == sum(map(len, brute.token_ids(BYTES, CASES)))
    assert token_matrix.pack_matrix(case.limit(0), BYTES, 64).collect() == []


def test_language_id(spark):
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    both = got.join(truth, "doc_id").filter("held_out")
    n, right, scores = both.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred")),
                                F.count_if(F.col("score").between(0, 1))).first()
    assert n > 150 and right / n > 0.97 and scores == n


def test_language_id_cases(spark):
    case = made(spark, CASES + ["123 ... ²", "ça"])
    model = language_id.fit(case)
    assert model.languages == ["en"]
    got = language_id.predict(case, model, {"text": F.col("text")}).collect()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"], r["score"] > 0) == (("en", True) if letters else ("und", False))
    none = language_id.fit(case.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(
        case, none, {"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert language_id.predict(case.limit(0), model, {"a": F.col("doc_id")}).collect() == []
    code = language_id.codewords(30).astype(int)
    assert ((code.shape[1] - code @ code.T) // 2)[~np.eye(30, dtype=bool)].min() >= 10
    # A text longer than a step of the sums gives the same as all at once.
    flat = np.ones((language_id.BUCKETS + 1, 1), np.float32)
    flat[-1] = 0
    two = language_id.Model(["a", "b"], np.array([[1], [-1]]), flat, np.ones(1))
    assert np.allclose(two.margins(["a", "x" * 9_000_000, "b"])[:, 0],
                       np.sqrt([2, 9_000_001, 2]))


def test_decontaminate(spark, docs):
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()]
    want = brute.hits(docs, items)
    assert any(w[5] for w in want)
    assert rows(queries.op6_decontaminate(spark, SF)) == want


def test_decontaminate_cases(spark):
    rng = random.Random(5)
    texts = [None, "", "...", "a b c", "é A-b C"] + [
        " ".join(rng.choices("abcD", k=rng.randint(1, 60))) for _ in range(150)]
    items = [(1, None), (2, ""), (3, "a b c a"), (3, "a b c a"), (4, "É a"), (None, "b b b c d")] + [
        (10 + i, " ".join(rng.choices("abcdABC", k=rng.randint(9, 30)))) for i in range(60)]
    case = made(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    ids = [r["doc_id"] for r in case.collect()]
    want = [w[:4] for w in brute.hits(list(zip(ids, texts)), items)]
    for block in (1 << 20, 1000):
        got = decontaminate.find(case, bench, block_bytes=block, shard_bytes=2000)
        got = [(r["doc_id"], r["n_words"], r["n_hit"], len(r["items"])) for r in got.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    clean = decontaminate.clean(case, bench)
    assert clean.columns == case.columns
    assert clean.count() == sum(w[2] == 0 for w in want)
    assert decontaminate.find(case.limit(0), bench).collect() == []
    assert decontaminate.find(case, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x the quick brown fox jumps y"), (2, "brown fox jumps over")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(7, "The quick brown fox jumps over it")],
                                  "item_id long, text string")
    got = rows(decontaminate.longest_matches(docs, bench))
    assert got == [(7, 0, 5, 1, 1), (7, 1, 4, 1, 2), (7, 2, 4, 2, 0), (7, 3, 3, 2, 1), (7, 4, 2, 2, 2)]


def test_suffix_order():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 300):
        ids = rng.integers(1, 4, n).astype(np.uint64)
        got = decontaminate.suffix_order(ids, 1 << 30).tolist()
        assert got == sorted(range(n), key=lambda i: ids[i:].tolist())


def test_simhash(spark, docs):
    assert rows(queries.op10_simhash_dedup(spark, SF)) == brute.simhash_rows(docs)
    case = made(spark, CASES)
    ids = [r["doc_id"] for r in case.collect()]
    assert rows(simhash_dedup.report(case)) == brute.simhash_rows(list(zip(ids, CASES)))
    assert simhash_dedup.report(case.limit(0)).collect() == []
    kept = simhash_dedup.keep_first(case)
    assert kept.columns == case.columns
    fps = [brute.simhash(t) for t in CASES]
    roots = brute.components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i)
                                        if (fps[i] ^ fps[j]).bit_count() <= 2])
    firsts = [min((ids[i] for i in range(len(fps)) if roots[i] == r and ids[i] is not None),
                  default=None) for r in set(roots)]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(firsts, key=repr)


def test_masks_cover():
    for radius in (1, 2, 3):
        own = [m % (1 << 64) for m in simhash_dedup.masks(radius)]
        rng = random.Random(radius)
        for _ in range(3000):
            bits = rng.sample(range(64), radius)
            assert any(not any(m >> b & 1 for b in bits) for m in own)


def test_near_fingerprints_in_one_bucket(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(400):
        f = base
        for b in rng.sample(range(64), rng.randint(1, 6)):
            f ^= 1 << b
        fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r["id"]: r["root"] for r in links.components(
        simhash_dedup.link(df, 2, block=50), "t").collect()}
    want = brute.components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i)
                                       if (fps[i] ^ fps[j]).bit_count() <= 2])
    same = {}
    for s, w in zip(signed, want):
        same.setdefault(w, set()).add(roots.get(s, s))
    assert all(len(x) == 1 for x in same.values())
    assert len({next(iter(x)) for x in same.values()}) == len(same)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 400)] + [(1000, 1000 + i) for i in range(300)]
    pairs += [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(700)]
    got = {r["id"]: r["root"] for r in links.components(
        spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    want = brute.components(3000, pairs)
    assert got == {i: want[i] for p in pairs for i in p if p[0] != p[1]} | {
        i: want[i] for i in got}
    assert links.components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


def test_embeddings(spark):
    data = [tuple(r) for r in table(spark, "embeddings").select("vec_id", "embedding",
                                                               "label").collect()]
    assert rows(queries.op8_embedding_dedup(spark, SF)) == brute.vector_rows(data)


def test_embedding_cases(spark):
    rng = np.random.default_rng(3)
    data, n = [], 0
    for c in rng.normal(size=(12, 16)):
        for _ in range(25):
            v = c + rng.normal(size=16) * 0.12
            data.append((n, [float(x) for x in v], int(n % 2)))
            n += 1
    data += [(n + i, data[0][1], 0) for i in range(40)] + [(3, data[3][1], 1), (None, data[5][1], 1)]
    data += [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [1.0, None], 0),
             (904, [float("nan")] * 16, 0), (905, [float("inf")] + [1.0] * 15, 0),
             (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, data[0][1], None),
             (909, [1e30] * 16, 1), (910, [1e-30] * 16, 1), (911, [5.0], 0), (912, [1.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    df = df.withColumn("__row", F.lit(1)).withColumn("key", F.lit("x"))
    want = brute.vector_rows(data)
    assert rows(embedding_dedup.near_duplicates(df, recall=1.0, k=6, block=20)) == want
    got = {r[0]: r[1] for r in rows(embedding_dedup.near_duplicates(df, k=6, block=20))}
    assert sum(n or 0 for n in got.values()) >= 0.9 * sum(w[1] for w in want if w[0] is not None)
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_languages_of_any_size_are_drawn():
    for rows in (1, 10, 2000, 10**6, 10**11, 10**15):
        drawn = (language_id.last_ticket(2000, rows) + 1) / language_id.TICKETS * rows
        assert abs(drawn - min(rows, 2000)) < 1e-3


def test_language_names_clash(spark):
    df = spark.createDataFrame([(1, "hello there", "en"), (2, "bonjour madame", "fr"), (3, None, None)],
                               "doc_id long, text string, lang string")
    model = language_id.fit(df)
    got = language_id.predict(df, model, {"doc_id": F.col("doc_id"), "score": F.lit("mine"), "text": F.col("text")})
    assert got.columns == ["doc_id", "score", "text", "lang_pred", "score_", "ambiguous"]
    assert [(r.score, r.lang_pred) for r in got.orderBy("doc_id").collect()] == [
        ("mine", "en"), ("mine", "fr"), ("mine", "und")]


def test_line_dedup_cases(spark):
    line = ["shared", " shared ", "SHARED"]
    data = [(i, f"text {i}\n{line[i % 2]}\n\nend {i}", f"s{i % 12}") for i in range(24)]
    data += [(100 + i, "copied\nwhole", f"s{i}") for i in range(12)]       # one text: not spread
    data += [(200, None, "s1"), (201, "", None), (202, "shared", "s1"), (203, "shared\n", None),
             (None, "shared\nshared\nlast", "s2")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    df = df.withColumn("h1", F.lit(1)).withColumn("n_lines", F.lit(777))
    got = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(df).collect()}
    assert got[0]["text"] == data[0][1] and got[1]["text"] == "text 1\n\nend 1"
    assert got[1]["n_lines_"] == 4 and got[1]["n_removed"] == 1
    assert {r["n_lines"] for r in got.values()} == {777}
    assert got[105]["text"] == "copied\nwhole"
    assert got[200]["text"] is None and got[200]["n_lines_"] == 0 and got[201]["text"] == ""
    assert got[202]["text"] == "" and got[203]["text"] == "" and got[None]["text"] == "last"
    assert len(got) == 24 + 12 + 5
    none = line_dedup.remove_boilerplate(df.limit(0))
    assert none.collect() == [] and none.columns[:5] == df.columns


def test_line_dedup_counts_sites_of_copies(spark):
    """Three texts hold a line; on 4 sites each, 11 or 9 distinct ones altogether."""
    sites = {"eleven": [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 3]],
             "nine": [[0, 1, 2, 3], [4, 5, 6, 7], [8, 0, 1, 2]]}
    data = [(f"{line} words\nonly {t} of {line}", f"s{s}") for line, texts in sites.items()
            for t, own in enumerate(texts) for s in own]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)],
                               "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(df).collect()}
    for i, (text, _) in enumerate(data):
        # The text of the least id keeps the line in all of its copies.
        gone = 4 <= i < 12
        assert got[i]["text"] == (text.split("\n")[1] if gone else text)
        assert got[i]["n_removed"] == int(gone)


def test_pii_base(spark, docs):
    got = queries.op5_pii(spark, SF).collect()
    want = sorted(brute.pii_row(*d) for d in docs)
    assert sorted(tuple(r)[:6] for r in got) == want
    assert sum(sum(w[1:5]) for w in want) > 10


def test_pii_cases(spark):
    rng = random.Random(8)
    letters = list("a1@.+- ()9") + ["é", "😀", "a@b.c", "192.168.1.1", "4111111111111111", "\n",
                                    "+1 (222) 555-1234", "4111 1111-1111 1111", "_"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(800)]
    texts += [None, "", "1" * 30_000, "a" * 100_000 + "@", "a.b@c.d_e@f.g", "1 " * 20_000,
              "999.1.1.1 000255.1.1.1.7.8.9.10", "😀 x@y.zz 4111111111111111!"]
    case = made(spark, texts)
    got = pii.find(case).select("doc_id", *(f"n_{k}" for k in pii.KINDS),
                                F.sha2(pii.written(F.col("base")), 256))
    ids = [r["doc_id"] for r in case.collect()]
    assert rows(got) == sorted((brute.pii_row(*d) for d in zip(ids, texts)), key=repr)
    assert pii.find(case.limit(0)).collect() == []


def test_pii_discovers(spark):
    """Numbers written after words that stand before many known ones."""
    texts = [f"Please call me at +1 555 000 {i:04d} today ok" for i in range(40)]
    texts += ["Please call me at 555-000-7777 today ok", "There were 5550008888 of them here"]
    got = pii.find(made(spark, texts)).filter(F.size("added") > 0).collect()
    assert [r["added"][0]["start"] for r in got] == [18] and len(got) == 1


def test_url_parts(spark):
    urls = ["HTTP://A.Example.NET/en/x?y#z", "http://net", "http://net/", "x://É.ORG/fr/?a://b/c",
            None, "no scheme", "http://a.org?q://b/c", "://h#f", "http://deep.b.example.com/de/1",
            "http://x.co.uk/p", "http://notnet/", "http://a.net/en/", "http://l\nf.net/\nq"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    pages = pages.unionByName(pages.limit(1)).withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([(1, None), (None, 1)], "page_id long, bad int")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(
        pages, none, queries.RULES).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("net", "", None, "allow"),
        2: ("net", "/", "net/", "block"), 3: ("É.org", "/fr/", "org/fr/", "allow"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("a.org", "", None, "allow"),
        7: ("h", "", None, "allow"), 8: ("deep.b.example.com", "/de/1", "example.com/de/", "block"),
        9: ("x.co.uk", "/p", None, "allow"), 10: ("notnet", "/", None, "allow"),
        11: ("a.net", "/en/", "net/", "block"), 12: ("l\nf.net", "/\nq", "net/", "block")}
    assert url_filter.judge(pages.limit(0), none, queries.RULES).collect() == []
    assert url_filter.judge(pages, none, []).filter("verdict = 'block'").count() == 0


def test_reputation_shrinks(spark):
    hosts = [(f"good{i}.fine.com", 200, 2) for i in range(10)] + [
        (f"bad{i}.evil.com", 200, 190) for i in range(10)] + [
        ("new.evil.com", 0, 0), ("new.fine.com", 0, 0), ("one.fine.com", 1, 1)]
    df = spark.createDataFrame(hosts, "host string, n long, k long")
    got = {r["host"]: r for r in url_filter.reputations(df).collect()}
    assert got["bad1.evil.com"]["bound"] > 0.5 > got["good1.fine.com"]["bound"]
    assert got["new.evil.com"]["mean"] > 0.7 and got["new.fine.com"]["mean"] < 0.3
    assert got["one.fine.com"]["bound"] < 0.5
