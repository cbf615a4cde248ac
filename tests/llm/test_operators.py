"""The training-data operators against brute force, on the driver's smallest tables and on awkward rows: nulls, empty and very long texts, ties, repeats, empty tables and extra columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbspark.llm import common, embedding_dedup, jaccard_join, license_scan, mixing, packing, pii, quality_classifier, quality_rules, token_binary, url_filters
from kbspark.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", None, "a"), (5, "same text of six words here", "en", None), (6, "same text of six words here", "en", "b"),
    (None, "no id on this one at all", "en", "b"), (6, "same text of six words here", "en", "b"), (7, LONG, "en", "c"), (8, "x" * 50_000, "en", "c"), (9, "a\tb  c\n\n d\r\ne \u00e9\u00df \u4e2d\u6587 \u00a0z", "fr", "c"), (10, "1" * 20_000 + "@" * 50, "fr", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, with columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({"score": F.lit(1), "rank": F.lit("x"), "kept": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").toPandas()


def result(spark, data, name):
    return Q.QUERIES[name](spark, data).toPandas()


# --- URL filters -------------------------------------------------------------------------------------------------------------------


def judged(url):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), v == "block", h + p) for h, p, v in Q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, ("block" if max(fits)[1] else "allow") if fits else "allow"


def test_urls(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").toPandas()
    got = result(spark, data, "op1_url_filters")
    assert sorted(zip(got.page_id, got.host, got.path, got.rule.fillna("-"), got.verdict)) == sorted((i, h, p, r or "-", v) for i, u in zip(pages.page_id, pages.url) for h, p, r, v in [judged(u)])


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x#y", "x://a://b/c", "http://com/en/", "http://xcom/en/", "http://a.net/de/\n1", "http://example.net/de/8", "http://" + "a." * 3000 + "org/es/" + "z" * 9000, "http://a.net/de/1", "http://a.net/de/1"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    rules = url_filters.rule_table(spark, Q.URL_RULES)
    got = url_filters.filter_urls(df, rules).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [judged(u) for u in urls]
    assert url_filters.filter_urls(df, rules.limit(0)).where("rule is null and verdict = 'allow'").count() == len(urls)
    assert url_filters.filter_urls(df.limit(0), rules).count() == 0


# --- tokens and packing --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer

    out = {n: Tokenizer.from_file(Q.tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
    for t in out.values():
        t.encode_special_tokens = True
    return out


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (token_binary.decode_ranks(*token_binary.encode_ranks(x), n) == x).all()
        ids = rng.integers(0, 50, n).astype(np.uint32)
        assert (token_binary.decode_file(*token_binary.encode_file(ids), n) == ids).all()


def expected_tokens(rows, tokenizer, end):
    return [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for i, t in rows]


def test_token_files(spark, data, docs, odd, tokenizers):
    got = {r.doc_id: r for r in result(spark, data, "op9_token_binary").itertuples()}
    start = 0
    for i, ids in expected_tokens(sorted(zip(docs.doc_id, docs.text)), tokenizers["word_bpe_49k.json"], 1):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rows = token_binary.read_token_files(token_binary.write_token_files(odd, Q.tokenizer_path("word_bpe_49k.json"), ids_per_file=5000)).orderBy("start").collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter((i, x.tobytes()) for i, x in expected_tokens([r[:2] for r in ODD], tokenizers["word_bpe_49k.json"], 1))
    assert rows[0].doc_id is None and [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:])
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert token_binary.token_digests(token_binary.write_token_files(odd.limit(0), Q.tokenizer_path("word_bpe_49k.json"))).count() == 0


def test_ranks_are_those_of_the_whole_table(spark, odd, tokenizers):
    files = token_binary.write_token_files(odd.repartition(3), Q.tokenizer_path("word_bpe_49k.json"), ids_per_file=50).collect()
    seen = Counter(int(x) for _, ids in expected_tokens([r[:2] for r in ODD], tokenizers["word_bpe_49k.json"], 1) for x in ids)
    (dictionary,) = [r for r in files if r.part == -1]
    assert np.frombuffer(dictionary.ranks, "<u4").tolist() == sorted(seen, key=lambda x: (-seen[x], x))
    assert len(files) > 2 and all(not r.ranks for r in files if r.part >= 0)
    assert sum(r.n_ids for r in files) == seen.total()


def test_one_id_is_dealt_over_tasks(spark):
    texts = [f"word{i % 7} and more" for i in range(400)]
    for rows in ([(None, t) for t in texts], [(5, texts[0])] * 400):
        files = token_binary.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), Q.tokenizer_path("word_bpe_49k.json"))
        assert files.where("part >= 0").select("part").distinct().count() > 1
        assert token_binary.read_token_files(files).count() == 400


def check_packed(rows, expected, window=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, ids in expected.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and bytes(r.ids) == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        total = sum(r.length for r in pieces)
        assert total == window or total < window and total & (total - 1) == 0


def test_packing(spark, data, docs, odd, tokenizers):
    t = tokenizers["byte_bpe_50k.json"]
    frame = spark.read.parquet(f"{data}/documents.parquet")
    check_packed(packing.pack(frame, Q.tokenizer_path("byte_bpe_50k.json"), shard_docs=64).collect(), dict(expected_tokens(zip(docs.doc_id, docs.text), t, 0)))
    rows = packing.pack(odd, Q.tokenizer_path("byte_bpe_50k.json")).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(r[0] for r in ODD)
    assert sum(r.length for r in rows) == sum(len(x) for _, x in expected_tokens([r[:2] for r in ODD], t, 0))
    assert packing.pack(odd.limit(0), Q.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_packing_finds_neighbours():
    rng = np.random.default_rng(0)
    topics = [rng.integers(1000 * k, 1000 * k + 60, (12, 100)).astype(np.uint32) for k in range(4)]
    docs = [x for group in zip(*topics) for x in group]  # topics alternate
    mixed = [len({i % 4 for i, _, _ in s}) for s in packing.pack_shard(docs, 400) if sum(n for _, _, n in s) == 400]
    assert sum(m == 1 for m in mixed) >= 0.7 * len(mixed)


def test_packing_follows_frequent_terms():
    """Copies that are a third of the documents find each other."""
    rng = np.random.default_rng(1)
    copy = np.arange(100, 180, dtype=np.uint32)
    docs = [copy if i % 3 == 0 else rng.integers(1000, 9000, 20).astype(np.uint32) for i in range(90)]
    made = [{i % 3 == 0 for i, _, _ in s} for s in packing.pack_shard(docs, 400) if sum(n for _, _, n in s) == 400]
    assert sum(m == {True} for m in made) == 30 * 80 // 400


def test_packing_goes_down_the_whole_list():
    """All terms of the seed are asked, and neighbours fill the window however many it takes."""
    rng = np.random.default_rng(2)
    docs = [np.concatenate([[k], rng.integers(10 + 40 * k, 50 + 40 * k, 5 - k)]).astype(np.uint32) for _ in range(150) for k in (0, 1)]
    first = packing.pack_shard(docs, 512)[0]
    assert len(first) > 80 and {i % 2 for i, _, _ in first} == {0}
    rare = [np.array([1000 + 40 * k + j for j in range(40)] + [7] * 20, np.uint32) for k in range(4)]  # related by one frequent term only
    others = [np.array([1000 + 40 * k + j for j in range(40)], np.uint32) for k in range(4)]
    made = packing.pack_shard([*rare, *others, *[np.array([9], np.uint32)] * 8], 104)
    assert [i for i, _, _ in made[0]][:3] == [0, 4, 1]


def test_packing_searches_all_partitions(spark, tokenizers):
    """Neighbours are found across partitions and shards, and the windows are those of one list with the whole table's counts."""
    rng = np.random.default_rng(3)
    words = [[f"{a}{b}" for b in ("stone", "river", "green", "window", "seven", "paper", "light", "cloud")] for a in ("north ", "old ", "cold ", "new ")]
    rows = [(i, " ".join(rng.choice(words[i % 4], int(rng.integers(20, 60))))) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    for df, options in ((frame.repartition(7), {"shard_docs": 5, "block": 9}), (frame.coalesce(1), {"block": 9})):
        got = packing.pack(df, Q.tokenizer_path("byte_bpe_50k.json"), window=256, **options).collect()
        check_packed(got, dict(expected_tokens(rows, tokenizers["byte_bpe_50k.json"], 0)), 256)
        sequences = defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.doc_id, r.start, r.length))
        made.append(Counter(tuple(sorted(x)) for x in sequences.values()))
    assert made[0] == made[1]
    # one seed after another, each scored by brute force against all documents
    docs = {i: ids for i, ids in expected_tokens(rows, tokenizers["byte_bpe_50k.json"], 0)}
    df, mean = Counter(t for x in docs.values() for t in set(x.tolist())), np.mean([len(x) for x in docs.values()])
    weight = {i: {t: round(65536 * float(np.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5))) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(x) / mean))) for t, n in Counter(x.tolist()).items()} for i, x in docs.items()}
    assert max(map(len, docs.values())) < 256
    seeds = [r.doc_id for r in spark.createDataFrame([(i, x.tobytes(), len(x)) for i, x in docs.items()], "doc_id long, ids binary, n long").orderBy(F.desc("n"), F.xxhash64("doc_id", "ids")).collect()]
    rest, want = {i: len(docs[i]) for i in seeds}, []
    for seed in seeds:
        row, room = [], 256
        near = sorted((i for i in seeds if i != seed), key=lambda i: -sum(weight[i].get(t, 0) for t in weight[seed]))  # stable
        for i in [seed, *near] if rest[seed] else []:
            n = min(room, rest[i])
            row += [(i, len(docs[i]) - rest[i], n)] if n else []
            rest[i] -= n
            room -= n
        want += [row] if row and not room else []
    assert sum(made[0][tuple(sorted(x))] for x in want) == len(want) and len(want) > 10


def test_seeds_are_looked_up_where_they_lie(spark, monkeypatch):
    """A block's seeds are asked of the parts that hold them alone, and every seed's part is among those."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["stone", "river", "green", "window"], int(rng.integers(5, 90))))) for i in range(160)]
    real, seen = packing._assign, []

    def assign(spark, index, terms, parts, before, *rest):
        held = {r.number: r.part for r in terms.select("number", "part").collect()}
        assert sorted(held) == list(range(160)) and len(parts) > 2
        seen.extend(parts[np.searchsorted(before, i, side="right") - 1] == part for i, part in held.items())
        real(spark, index, terms, parts, before, *rest)

    monkeypatch.setattr(packing, "_assign", assign)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = packing.pack(frame, Q.tokenizer_path("byte_bpe_50k.json"), window=256, block=7).agg(F.count_distinct("doc_id")).first()[0]
    assert got == 160 and len(seen) == 160 and all(seen)


def test_bounds_rule_out_documents_and_lose_none():
    """Lists from bounded shards, before and after used documents are dropped from them, are those of every document's score; most pairs aren't scored."""
    rng = np.random.default_rng(6)
    docs = [np.unique(rng.integers(400 * (i % 4), 400 * (i % 4) + 150 + 250 * (i % 3 > 0), int(rng.integers(2, 30 if i % 5 else 160)))).astype(np.uint32) for i in range(1200)]
    docs += docs[:40]  # equal scores, of which the smaller number comes first
    tf = [rng.integers(1, 4, len(x)).astype(np.uint32) for x in docs[:1200]]
    tf += tf[:40]
    idf = np.log1p(1240 / (1 + np.bincount(np.concatenate(docs), minlength=1600)))
    middle = packing.centres(docs[::5], idf, np.arange(1600))
    rows = {"number": list(range(1240)), "terms": [x.tobytes() for x in docs], "tf": [x.tobytes() for x in tf], "n": [int(x.sum()) for x in tf]}
    batch = pa.record_batch([pa.array(rows["number"], pa.int64()), pa.array(rows["terms"], pa.binary()), pa.array(rows["tf"], pa.binary()), pa.array(rows["n"], pa.int64())], names=list(rows))
    mean = np.mean(rows["n"])
    weights = [np.rint(65536 * idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) for t, f, n in zip(docs, tf, rows["n"])]
    table = np.zeros((1240, 1600))
    for i, (t, w) in enumerate(zip(docs, weights)):
        table[i, t] = w

    class Sent:
        def __init__(self, value):
            self.value = value

    index = pa.Table.from_batches(packing._indexer(Sent((idf, mean, middle)), 40_000, 32)([batch])).combine_chunks().to_batches()
    asked = list(range(0, 1240, 7))
    for used in (np.zeros(1240, bool), rng.random(1240) < 0.7):
        bits = np.packbits(used, bitorder="little")
        small = pa.Table.from_batches(packing._compact(Sent(bits), 32)(index)).combine_chunks().to_batches()
        assert small[0].num_rows < index[0].num_rows
        for held in (index, small):
            got = pa.Table.from_batches(packing._search(Sent(([docs[i] for i in asked], bits, 9)))(held)).to_pylist()
            for q, i in enumerate(asked):
                score = table[:, docs[i]].sum(1)
                score[used] = 0
                best = [k for k in np.lexsort((np.arange(1240), -score))[:9].tolist() if score[k] > 0]
                assert [(r["number"], r["score"]) for r in got if r["query"] == q] == [(k, score[k]) for k in best]
    lists = packing.Questions([docs[i] for i in asked], 9)
    for row in sorted(zip(*(c.to_pylist() for c in index[0].columns)), key=lambda r: -r[1]):
        lists.search(*packing._unused(row, np.zeros(155, np.uint8)))
    assert lists.scored < 0.6 * 1240 * len(asked)
    large = packing.Questions([np.arange(300, dtype=np.uint32)], 2)  # sums over 2^24, in parts below it
    large.search(np.arange(64), np.arange(300), np.full(300, 64), np.tile(np.arange(64), 300), np.repeat(np.arange(300), 64) * 1001 + 900_001)
    assert large.score[0].tolist() == [sum(k * 1001 + 900_001 for k in range(300))] * 2 and large.number[0].tolist() == [0, 1]


def test_pieces_agree_with_the_whole(tokenizers):
    texts = ["a\t b", "a  b\n\nc \n d", "", "  ", "\n", "it's o'clock 's", "\u4e2d\u6587 b\u3000c", "e\u0301\u0301 x", "\u03a3 \u0391\u03a3", "<|endoftext|> x", "a\x1cb \x85 d", "\u00c9t\u00e9\u0301 \u00c0\u00d6!!", "a\0b c", "don't_x isn't: \n", " lead", "trail ", "na\u00efve... _a_ \u00ff\u00df\u00d7\u00f7", "x\u2028y\u00a0z"]
    for name, pieces, lower in (("byte_bpe_50k.json", packing.spaced_pieces, False), ("word_bpe_49k.json", token_binary.ascii_words, True)):
        coder = common.WordTokenizer(Q.tokenizer_path(name), pieces, lower, 10)
        for t in texts:
            assert coder.encode(t.encode(), 0).tolist() == [*tokenizers[name].encode(t, add_special_tokens=False).ids, 0], repr(t)


# --- quality -------------------------------------------------------------------------------------------------------------------------


def test_classifier(spark, data, odd):
    data = data.replace("sf0.001", "sf0.01")  # the smallest tables have 23 held-out rows
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = result(spark, data, "op3_quality_classifier").merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    held = got[got.held_out]
    assert ((held.predicted == held.quality).mean()) >= 0.95
    rows = quality_classifier.classify(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_classifier.classify(odd, labels.limit(0)).collect()} == {1 / (1 + np.exp(-35.0))}
    assert quality_classifier.classify(odd.limit(0), labels).count() == 0


def plain_ftrl(rows, passes, alpha=0.8, beta=1.0, l1=0.02, l2=0.2, balance=0.9):
    """Follow the regularised leader, one coordinate at a time, on (features, label) rows."""
    share = sum(y for _, y in rows) / len(rows)
    ratio = (share / (1 - share)) ** balance
    z, n, bias, bias_n = defaultdict(float), defaultdict(float), np.log(share / (1 - share)) * (1 - balance), 1.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2)

    for _ in range(passes):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            error = (1 / (1 + np.exp(-(bias + sum(w[i] * v for i, v in x.items())))) - y) * max(ratio if y == 0 else 1 / ratio, 1.0)
            for i, v in x.items():
                g = error * v
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            bias -= 0.05 * error / np.sqrt(bias_n)
            bias_n += error * error
    return lambda x: 1 / (1 + np.exp(-(bias + sum(weight(i) * v for i, v in x.items()))))


def test_classifier_against_plain_updates(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels, updates=200, sample=40).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    known = {}
    for r in labels.collect():
        if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            known[r.doc_id] = min(r.quality, known.get(r.doc_id, 1))
    order = [r.doc_id for r in labels.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").collect() if r.doc_id in known][:40]
    x = {i: dict(zip(*(a.tolist() for a in quality_classifier.features(t, 18)))) for i, t in texts.items()}
    rows = [(x[i], known[i]) for i in order if i in x]
    score = plain_ftrl(rows, max(3, 200 // len(rows)))
    assert len(got) == len(texts) and all(abs(got[i] - score(x[i])) < 1e-9 for i in texts)
    # the features themselves: hashed tokens and pairs of them, logarithmic counts scaled to length one
    one = quality_classifier.features(b"aa bb aa", 18)
    assert len(one[0]) == 4 and np.isclose((one[1] ** 2).sum(), 1) and np.isclose(one[1].max() / one[1].min(), np.log(3) / np.log(2))


def test_classifier_sample_is_bounded_in_features(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    assert quality_classifier.fit(docs, labels, sample_features=0).bias == 35.0


def base_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, data, docs, odd):
    got = result(spark, data, "op5_quality_rules").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    rows = quality_rules.judge(odd.withColumns({"n_words": F.lit("x"), "word_chars": F.lit(0), "symbol_pm": F.lit(1)})).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == Counter((r[0], *base_counts(r[1])) for r in ODD)
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_quality_sketches_merge(spark):
    rng = np.random.default_rng(2)
    values = [int(v) for v in rng.lognormal(4, 2, 4000)]
    df = spark.createDataFrame([("en" if i % 3 else None, f"s{i % 5}", *[v] * len(quality_rules.MEASURES)) for i, v in enumerate(values)], "lang string, source string, " + ", ".join(f"{m} long" for m in quality_rules.MEASURES))
    fine = quality_rules.sketch(df, ["lang", "source"])
    whole = quality_rules.merge(fine, [])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, quality_rules.sketch(df, []).collect()))
    q = quality_rules.quantiles(whole, []).where("measure = 'symbol_pm'").first()
    for at in (10, 50, 90):
        exact = sorted(values)[-(-len(values) * at // 100) - 1]
        assert exact * 15 / 16 - 1 <= q[f"q{at}"] <= exact


def _by_hand(rows: list[tuple[str, str, int]], least: int) -> dict[tuple[str, str], tuple[int, int]]:
    """The tenth percentile and the median of each group: shares up to each edge, of the group, its language and the whole, one added to the other."""
    edge = lambda v: v >> max(v.bit_length() - 5, 0) << max(v.bit_length() - 5, 0)
    edges = sorted({edge(v) for _, _, v in rows})
    upto = lambda values: [sum(edge(v) <= e for v in values) for e in edges]
    every = [v for _, _, v in rows]
    whole = [n / len(every) for n in upto(every)]
    out = {}
    for lang, source in {(a, b) for a, b, _ in rows}:
        of_lang, own = [v for a, _, v in rows if a == lang], [v for a, b, v in rows if (a, b) == (lang, source)]
        lang_share = [(n + least * w) / (len(of_lang) + least) for n, w in zip(upto(of_lang), whole)]
        share = [(n + least * w) / (len(own) + least) for n, w in zip(upto(own), lang_share)]
        out[lang, source] = tuple(next(e for e, x in zip(edges, share) if x * 100 >= q) for q in (10, 50))
    return out


def test_quality_thresholds_have_no_edge(spark):
    rng = np.random.default_rng(4)
    ddl = "lang string, source string, " + ", ".join(f"{m} long" for m in quality_rules.MEASURES)
    common_rows = [("en", "big", int(v)) for v in rng.normal(5000, 400, 3000)] + [(None, "big", int(v)) for v in rng.normal(5200, 300, 900)] + [("fr", None, 700)]
    small = [("en", "small", int(v)) for v in rng.normal(2500, 200, 400)]
    highs = {}
    for n in (0, 1, 199, 201, 400):
        rows = common_rows + small[:n]
        df = spark.createDataFrame([(a, b, *[v] * len(quality_rules.MEASURES)) for a, b, v in rows], ddl)
        got = {(r.lang, r.source): r.high for r in quality_rules.thresholds(quality_rules.sketch(df, ["lang", "source"])).where("measure = 'word_length_pm'").collect()}
        assert got == {k: q50 + 4 * max(q50 - q10, 1000) for k, (q10, q50) in _by_hand(rows, 200).items()}
        highs[n] = got.get(("en", "small"))
    assert abs(highs[199] - highs[201]) <= 300 < highs[1] - highs[400]


# --- mixing --------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 50, "b": 30, "c": 19, "d": 1}, {"a": 7, "b": 7, "c": 3}, {f"s{i}": i + 1 for i in range(20)}])
def test_schedule_stays_within_a_block(shares):
    plan = mixing.schedule(shares)
    total, done = sum(shares.values()), Counter()
    assert [slot for _, _, slot in plan] == list(range(total))
    for source, k, slot in plan:
        assert k == done[source]
        done[source] += 1
        assert all(abs(done[s] - (slot + 1) * shares[s] / total) < 1 for s in shares)


def test_mixing(spark, data, docs, odd):
    got = result(spark, data, "op6_source_mixing")
    assert len(got) == len(docs) and not got.duplicated(["mix_slot", "mix_seq", "source"]).any()
    rows = mixing.mix(odd, {"a": 2, "b": 1}, block_chars=30).orderBy("mix_slot", "mix_seq").collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter((r[0], r[1], r[3]) for r in ODD)
    assert {r.source for r in rows if r.mix_slot >= 1 << 62} == {None, "c"}
    blocks = {(r.source, r.mix_block): r.mix_slot for r in rows if r.source in ("a", "b")}
    assert len(set(blocks.values())) == len(blocks)
    assert mixing.mix(odd.limit(0), {"a": 1}).count() == 0 and mixing.mix(odd, {}).count() == len(ODD)
    assert mixing.whole_weights({"a": 0.5, "b": 0.25, "c": 0.25}, 100) == {"a": 50, "b": 25, "c": 25}


def test_mixing_spreads_rows_without_ids(spark):
    rows = [(None, f"text {i}", "a") for i in range(400)] + [(7, f"other {i}", "a") for i in range(400)] + [(None, None, "a")] * 3
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 1}, block_chars=500)
    got = mixed.orderBy("mix_slot", "mix_seq").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((a, b) for a, b, _ in rows)
    assert len({r.mix_seq >> 40 for r in got if r.doc_id is None}) > 300 and len({r.mix_seq >> 40 for r in got if r.doc_id == 7}) > 300
    begun = 0
    for r in got:
        assert r.mix_block == begun // 500
        begun += len(r.text or "")


# --- near duplicates -----------------------------------------------------------------------------------------------------------------


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        out[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    return out


def check_groups(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(df, **options).collect()}
    sets = shingle_sets(rows)
    names = sorted(sets)
    links = [(a, b) for k, a in enumerate(names) for b in names[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(names, links)
    assert got == {i: (len(sets[i]), want[i]) for i in names}
    return len(links)


def test_jaccard_groups(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary, 60))
    rows, texts = [], []
    for k in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 150))))
        texts.append(" ".join(words))
        for _ in range(int(rng.integers(0, 4))):
            copy = list(words)
            for _ in range(int(rng.integers(0, max(1, len(copy) // 25) + 1))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy).upper() if k % 3 else "\n".join(copy))
        texts.append(passage + " " + " ".join(rng.choice(vocabulary, int(rng.integers(1, 40)))))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    assert check_groups(spark, rows) > 50
    assert check_groups(spark, rows, tile_docs=3, tile_shingles=200) > 50


def test_odd_texts_in_groups(spark, odd):
    rows = jaccard_join.similar_groups(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    assert {r.doc_id: r.component_id for r in rows} == {r[0]: 5 if r[0] == 6 else r[0] for r in ODD}
    assert jaccard_join.similar_groups(odd.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    for edges in ([(i, i + 1) for i in range(60)], [(int(a), int(b)) for a, b in rng.integers(0, 90, (70, 2))], [(0, i) for i in range(40)], [(5, 5), (None, 3), (2, None)]):
        df = spark.createDataFrame(edges, "a long, b long").repartition(3)
        clean = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
        old, common.FOREST_EDGES = common.FOREST_EDGES, 7  # so that rounds are needed
        try:
            got = {r.id: r.component for r in common.connected_components(df).collect()}
        finally:
            common.FOREST_EDGES = old
        assert got == components({x for e in clean for x in e}, clean)


def test_hot_keys_are_dealt_over_tasks(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), "id")
    right = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = common.hot_keys(left.where("k is not null"), ["k"], most=1000, least=100)
    assert [r.k for r in hot.collect()] == [7]
    got = common.join_spread(left, right, ["k"], ["id"], hot=hot)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, "k", "left").collect()), key=str)
    inner = common.join_spread(left, right, ["k"], ["id"], "inner", hot=hot)
    assert inner.count() == left.join(right, "k").count()


def test_scratch_tables_go_at_the_end(spark):
    import os

    with common.scratch(spark):
        df = common.cut(spark.range(5), "scratch-test")
        folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert df.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24))
    rows = []
    for k, v in enumerate(base):
        rows += [v + rng.normal(size=24) * s for s in (0.0, 0.05, 0.1, 0.2, 0.3)[: 1 + k % 5]]
    rows += [rows[0].copy(), rows[0] * 3, np.zeros(24), np.full(24, np.nan), np.full(24, np.inf)]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(900, None), (901, [1.0, 2.0]), (902, [None] * 24)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    good = {i: np.array(v, float) for i, v in data if v is not None and len(v) == 24 and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95]
    want, degree = components([i for i, _ in data], links), Counter(x for e in links for x in e)
    for options in ({}, {"list_size": 8, "tile": 5, "margin": 0.5 * np.sqrt(0.1)}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, **options).collect()}
        assert got == {i: (degree[i], want[i], want[i] == i) for i, _ in data}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    doubled = embedding_dedup.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in doubled) == [(0, 0, False), (1, 1, True), (1, 1, True)]


def test_embedding_recall(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    x = np.array(v.embedding.tolist(), float)
    rng = np.random.default_rng(6)
    x = np.concatenate([x, x[:200] + rng.normal(size=(200, x.shape[1])) * 0.035])  # cosines about 0.96
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = int((np.triu(x @ x.T, 1) >= 0.95).sum())
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = embedding_dedup.near_duplicates(df, list_size=20).agg(F.sum("n_links")).first()[0] // 2
    assert true > 100 and 0.99 * true <= found <= true


def test_embedding_links_across_borders(spark):
    """Vectors along an arc: links run straight across the borders of the lists."""
    rng = np.random.default_rng(9)
    a, b = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
    at = np.linspace(0, 2.5, 600)
    x = np.cos(at)[:, None] * a + np.sin(at)[:, None] * b + rng.normal(size=(600, 16)) * 0.004
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    degree = (x @ x.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, list_size=15).collect()}
    assert got == {i: (int(n), 0) for i, n in enumerate(degree)}


# --- personal data -------------------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans():
    rng = np.random.default_rng(7)
    letters = list("aA1259.@-+ (%)")
    for _ in range(20_000):
        t = "".join(rng.choice(letters, int(rng.integers(1, 40))))
        assert pii.base_spans(t) == plain_spans(t), t
    assert len(pii.base_spans("1" * 100_000 + "a" * 100_000)) == 0


def test_gradients():
    rng = np.random.default_rng(8)
    m = pii.Tagger.fresh(3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y = rng.integers(0, pii.N_CLASSES, (2, 6)), rng.integers(0, pii.N_TAGS, (2, 6))
    _, grad = m.gradients(x, y)
    for k in m.p:
        at = tuple(rng.integers(0, n) for n in m.p[k].shape) if k != "x" else (0, int(x[0, 0]), 1)
        m.p[k][at] += 1e-3
        up = m.gradients(x, y)[0]
        m.p[k][at] -= 2e-3
        down = m.gradients(x, y)[0]
        m.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - grad[k][at]) < 2e-3, k


@pytest.fixture(scope="module")
def tagger(docs):
    return pii.train([t[i : i + pii.STRETCH] for t in docs.text.tolist()[:100] for i in range(0, max(1, len(t) - pii.STRETCH), 400)])


def test_tagger_on_held_out_windows(tagger, docs):
    x, y = pii.examples(docs.text.tolist()[100:], 300, 80, seed=99)
    found = tagger.decode(x)
    assert (found == y).mean() > 0.97
    hits = sum(len(set(pii.spans_of(a)) & set(pii.spans_of(b))) for a, b in zip(y, found))
    assert hits > 0.85 * sum(len(pii.spans_of(a)) for a in y)


def test_personal_data(spark, tagger, docs, odd):
    for t, (base, spans) in zip(docs.text, pii.find_spans(tagger, docs.text.tolist())):
        assert base == plain_spans(t) and set(base) <= set(spans)
    rows = pii.detect(odd, tagger).collect()
    assert Counter((r.doc_id, r.base_spans) for r in rows) == Counter((r[0], pii.written(plain_spans(r[1]))) for r in ODD)
    assert next(r for r in rows if r.doc_id == 1).redacted is None
    assert pii.redact("a b@c.de x", [("email", 2, 8)]) == "a [EMAIL] x"
    assert pii.detect(odd.limit(0), tagger).count() == 0


def test_windows_agree_across_a_long_text(tagger):
    t = "word " * 37 + "mail bob.smith@example.com now " + "word " * 90 + "ip 10.20.30.40 " + "word " * 50
    tags = pii.tag_text(tagger, [t])[0]
    assert len(tags) == len(t) and {("email", 190, 211)} <= set(pii.spans_of(tags)) and [len(x) for x in pii.tag_text(tagger, ["no trigger here", ""])] == [15, 0]


#: Written by hand, not by the generator of the training lines.
BY_HAND = [
    ("email", "anna (dot) kowalski (at) mailbox (dot) example (dot) org"), ("email", "jo.smith [at] example [dot] com"), ("email", "maria dot lopez at post dot example dot net"),
    ("card", "4111.1111.1111.1111"), ("card", "5500/0000/0000/0004"), ("phone", "(0) 171 555 0142"),
]


def test_spans_over_seams_are_those_inside(tagger, docs):
    """Each form is moved over every place of a seam, in three surroundings: found there as often as in the middle of a window."""
    clean = re.sub(r"\S*[0-9@]\S*", "", " ".join(t for t in docs.text.tolist() if t)[:9000])
    clean = re.sub(r"[^A-Za-z ]+", " ", clean)
    found = {}
    for at in (250, 480, 928):  # the middle of the first window; its seam with the second; the next
        texts, gold = [], []
        for shift in range(-70, 15, 5):
            for begin in (0, 2000, 4000):
                for kind, put in BY_HAND[:5]:
                    before = clean[begin : begin + at + shift - 1] + " "
                    texts.append(before + put + " " + clean[begin + 1200 : begin + 2100])
                    gold.append((kind, len(before), len(before) + len(put)))
        spans = pii.find_spans(tagger, texts)
        found[at] = [g in s for g, (_, s) in zip(gold, spans)]
    assert np.mean(found[250]) > 0.5
    for at in (480, 928):
        assert np.mean(found[at]) > np.mean(found[250]) - 0.03, (at, np.mean(found[at]), np.mean(found[250]))
    # and the tags are those that one window over the whole text gives
    whole = pii.tag_text(tagger, texts, window=4096, stride=4096 - 2 * pii.MARGIN)
    same = [pii.spans_of(a) == pii.spans_of(b) for a, b in zip(pii.tag_text(tagger, texts), whole)]
    assert np.mean(same) >= 0.98, np.mean(same)


def test_every_window_is_searched_where_it_must_be(tagger, docs):
    """The bound that spares windows the search gives the same tags as searching all of them."""
    x = np.array([pii.classes(t[:200].ljust(200)) for t in docs.text if t] + list(pii.examples(docs.text.tolist(), 60, 200, seed=5)[0]))
    assert (tagger.decode(x) == tagger._best_paths(tagger.scores(x))).all()


def test_texts_that_can_hold_no_span_are_not_decoded(tagger, docs, monkeypatch):
    """The same spans as when every text is decoded; only texts in which no stretch is valid are left out."""
    rng = random.Random(5)
    pieces = ["a", "b", "at", "AT", " ", " ", "\u00a0", "@", "dot", "dot", ".", ".", "[", "]", "(", ")", "{", "}", "1", "2", "12", "255", "-", "+", "_", "/", "\n", "\u212a", "\u0663"]
    held = Counter()
    for _ in range(6000):
        kind = rng.choice((pieces, pieces[9:], ("a", " ", " at ", "[at]", "@", ".", " DOT ", "b1"), ("1", "23", "456", " ", "-", ".", "/", "[.]", "\u0663")))
        t = "".join(rng.choice(kind) for _ in range(rng.randint(1, 24)))
        valid = any(pii._valid(k, t[a:b]) for a in range(len(t)) for b in range(a + 1, len(t) + 1) for k in pii.KINDS)
        assert pii.may_hold(t) or not valid, t
        held[pii.may_hold(t), valid] += 1
    assert held[True, True] > 50 and held[False, False] > 1000
    assert all(pii.may_hold(f"so {put} it is") for _, put in BY_HAND)
    assert all(pii.may_hold("x " + pii.loose_form(form, rng)[1] + ".") for form in pii.LOOSE_FORMS for _ in range(50))
    texts = [t or "" for t in docs.text] + [f"{t[:700]} {put} {t[:300]}" for t, (_, put) in zip(docs.text, BY_HAND * 5)]
    seen = []
    scores = pii.Tagger.scores
    monkeypatch.setattr(pii.Tagger, "scores", lambda self, x: (seen.append(x.size), scores(self, x))[1])
    found = pii.find_spans(tagger, texts)
    some = sum(seen)
    monkeypatch.setattr(pii, "may_hold", lambda t: True)
    assert pii.find_spans(tagger, texts) == found and any(len(b) < len(s) for b, s in found)
    assert 0 < some < (sum(seen) - some) / 2


def test_forms_beyond_the_patterns(tagger, docs):
    """Held-out lines: nine in ten of each form, which no base pattern finds whole, and nothing in lines without any."""
    rng = random.Random(41)
    clean = [re.sub(r"\S*[0-9@]\S*", "", t[i : i + 150]) for t in docs.text.tolist()[100:] for i in [len(t) // 3]]
    lines, gold = [], []
    for form in pii.LOOSE_FORMS:
        for _ in range(40):
            before, after = rng.choice(clean), rng.choice(clean)
            kind, put = pii.loose_form(form, rng)
            lines.append(f"{before} {put}{rng.choice(('', '.', ','))} {after}")
            gold.append((form, (kind, len(before) + 1, len(before) + 1 + len(put))))
    hits = Counter(form for (form, span), (_, spans) in zip(gold, pii.find_spans(tagger, lines)) if span in spans)
    assert not any(span in plain_spans(line) for (_, span), line in zip(gold, lines))
    assert {f: hits[f] for f in pii.LOOSE_FORMS if hits[f] < 36} == {}
    others = [f"{a} {put} {b}" for a, b, put in zip(clean, clean[1:], ["version 2.14", "2024-11-05", "12:30", "at 5 dot", "4.0", "1234567", "$120.50", "a dot at it", "1" * 24] * len(clean))]
    assert all(not spans for _, spans in pii.find_spans(tagger, [*clean, *others]))


# --- licences ------------------------------------------------------------------------------------------------------------------------


def test_licences(spark, data, docs, odd):
    got = result(spark, data, "op8_license_scan").set_index("doc_id")
    marks = {"MIT License": "MIT", "GNU General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "Apache License, Version 2.0": "Apache-2.0"}
    for i, t in zip(docs.doc_id, docs.text):
        want = next((v for k, v in marks.items() if k in t), None)
        assert (got.loc[i].license or None) == want or want is None and got.loc[i].license_via == "inherited"
    files = [
        ("p/LICENSE", "Released under the MIT License."), ("p/src/a.py", "x = 1"), ("p/src/b.py", "# Licensed under the Apache License, Version 2.0.\n" + "\n".join(f"y{i} = {i} + value" for i in range(9))), ("p/lib/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("p/lib/deep/c.py", "z"), ("q/d.py", "the license of the door"), (None, "e"), ("f", None), ("p/lib/g.py", ""),
    ]
    df = spark.createDataFrame([(*f, "mine") for f in files], "path string, text string, license string")
    rows = {r.path: (r.license, r.license_via) for r in license_scan.scan(df).collect()}
    assert rows == {"p/LICENSE": ("MIT", "file"), "p/src/a.py": ("MIT", "inherited"), "p/src/b.py": ("Apache-2.0", "header"), "p/lib/COPYING": ("GPL-3.0", "file"), "p/lib/deep/c.py": ("GPL-3.0", "inherited"), "q/d.py": (None, None), None: (None, None), "f": (None, None), "p/lib/g.py": ("GPL-3.0", "inherited")}
    assert license_scan.scan(df.limit(0)).count() == 0
    assert license_scan.scan(odd.withColumn("path", F.col("source"))).count() == len(ODD)


MIT_TEXT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def test_whole_licence_texts(spark):
    """Licence texts that are more than a notice, and notices in lines that don't end."""
    rest = " ".join(f"other{i}" for i in range(400))
    gpl = "GNU GENERAL PUBLIC LICENSE\nVersion {}\n\n" + rest + "\nyou can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    files = [
        ("m/LICENSE", MIT_TEXT), ("m/a.py", "x"), ("g2/COPYING", gpl.format("2, June 1991")), ("g2/b.py", "y"), ("g3/COPYING", gpl.format("3, 29 June 2007")), ("g3/c/d.py", "z"),
        ("l/long.txt", rest + " Licensed under the Apache License, Version 2.0. " + rest), ("l/wrapped.txt", rest + "\n# Licensed under the Apache\n# License, Version 2.0.\n" + rest), ("l/none.txt", rest + " the license of the door " + rest),
    ]
    rows = {r.path: (r.license, r.license_via) for r in license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert rows == {
        "m/LICENSE": ("MIT", "file"), "m/a.py": ("MIT", "inherited"), "g2/COPYING": ("GPL-2.0", "file"), "g2/b.py": ("GPL-2.0", "inherited"), "g3/COPYING": ("GPL-3.0", "file"), "g3/c/d.py": ("GPL-3.0", "inherited"),
        "l/long.txt": ("Apache-2.0", "header"), "l/wrapped.txt": ("Apache-2.0", "header"), "l/none.txt": (None, None),
    }


def plain_licences(files, header=0.7, file=0.8):
    """(license, via, score) of each (path, text): every line, whole text and passage against every template, without anchors or bounds; then the nearest directory."""
    named = [(name, Counter(license_scan.terms_of(t))) for name, texts in license_scan.TEMPLATES.items() for t in texts]
    docs = [license_scan.terms_of(t or "") for _, t in files]
    df = Counter(t for d in docs for t in set(d))
    known = {t for _, c in named for t in c}
    idf = lambda t: np.log((1 + len(files)) / (1 + (df[t] if t in known else 0))) + 1
    norm = lambda c: np.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items()))
    units = [(name, sum(c.values()), {t: n * idf(t) / norm(c) for t, n in c.items()}) for name, c in named]

    def cosine(terms, unit):
        c = Counter(terms)
        dot = sum(n * idf(t) * unit[t] for t, n in c.items() if t in unit)
        return round(dot / norm(c), 6) if dot else 0.0

    def best(*parts):
        return max([(cosine(p, unit), name) for p in parts for name, _, unit in units if p], default=(0.0, ""))

    own = []
    for (path, text), terms in zip(files, docs):
        line = best(*(license_scan.terms_of(x) for x in (text or "").split("\n")))
        for name, n, unit in units:
            for i in range(len(terms) - n + 1):
                if not unit.keys().isdisjoint(terms[i : i + n]):
                    line = max(line, (cosine(terms[i : i + n], unit), name))
        whole = best(terms)
        licence_file = re.search(license_scan.LICENCE_FILE_NAME, path or "") is not None and max(line, whole)[0] >= header
        own.append((max(line, whole) if licence_file else whole if whole[0] >= file else None, line if line[0] >= header else None))
    folder = lambda p: p.rpartition("/")[0] if p else ""
    given = {}
    for (path, _), (found, _) in zip(files, own):
        if found and folder(path):
            given[folder(path)] = max(found, given.get(folder(path), (0.0, "")))
    out = []
    for (path, _), (found, head) in zip(files, own):
        up, at = folder(path), None
        while up and at is None:
            at, up = given.get(up), up.rpartition("/")[0]
        got, via = next(((x, v) for x, v in ((found, "file"), (head, "header"), (at, "inherited")) if x), ((None, None), None))
        out.append((got[1], via, got[0]))
    return out


def test_licences_against_plain_scores(spark, docs):
    """All short texts of the table, licence files and whole licences among them, to six decimals."""
    short = [(s, x, i, t) for s, x, i, t in zip(docs.source, docs.lang, docs.doc_id, docs.text) if len(t) < 1500]
    files = [(f"{s}/{x}/{i}", t) for s, x, i, t in short] + [("src1/LICENSE", MIT_TEXT), ("src1/en/COPYING", "GNU GENERAL PUBLIC LICENSE Version 2"), ("src2/en/notice.txt", "nothing of the kind"), ("src2/license", "Licensed under CC BY 4.0. " * 3), (None, "x"), ("a/b", None), ("h/a.py", "# Licensed under the MIT License.\n" + "\n".join(f"y{i} = {i} + value" for i in range(9)))]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "n long, path string, text string")
    got = [(r.license, r.license_via, r.license_score) for r in license_scan.scan(df).orderBy("n").collect()]
    expected = plain_licences(files)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert all(a[2] is None and b[2] is None or abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, expected))
    assert {"file", "header", "inherited", None} == {g[1] for g in got}


# --- pipeline ------------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, data, docs):
    import corpus_pipeline

    frame = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = common.cut(stages["quality classifier"](spark, frame, data), "t")
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    assert sum(labels[i] == (i in kept) for i in labels) >= 0.9 * len(labels)
    unique = common.cut(stages["near duplicates"](spark, good, data), "t")
    groups = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(good).collect()}
    assert sorted(r.doc_id for r in unique.select("doc_id").collect()) == sorted(set(groups.values()))
    masked = common.cut(stages["personal data"](spark, unique, data), "t")
    assert all(not plain_spans(r.text) for r in masked.collect()) and masked.columns == frame.columns
    mixed = common.cut(stages["source mixing"](spark, masked, data), "t")
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, masked.collect()))
    pieces = stages["retrieval packing"](spark, mixed, data)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(groups.values())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), data).count() == 0, name
    whole = corpus_pipeline.run(spark, data).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert Counter({r.doc_id: r.n for r in whole}) == Counter({r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()})


def test_sequences_follow_the_mixture(spark):
    """Packing numbers sequences by the places that the mixture gave their first documents; without the mixture they come otherwise."""
    import corpus_pipeline

    rng = np.random.default_rng(12)
    words = np.array(["stone", "river", "green", "window", "seven", "paper", "light", "cloud", "north", "cold"])
    sources = ["src9"] * 120 + ["src0"] * 60 + ["src1"] * 40  # one after another
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(200, 3000)))), "en", s, 0) for i, s in enumerate(sources)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3, "doc_id")
    slots = {r.doc_id: (r.mix_slot, r.mix_seq) for r in mixing.mix(frame, Q.MIX_SHARES, Q.MIX_OTHER).collect()}
    assert len({slot for slot, _ in slots.values()}) > 15
    packs = []
    for stage in (corpus_pipeline.mixture, lambda spark, docs, sf_dir: docs):
        got = corpus_pipeline.packed(spark, common.cut(stage(spark, frame, ""), "t"), "").collect()
        firsts = sorted((r.sequence_id, r.doc_id, r.start) for r in got if r.offset == 0)
        assert len({i for i, _, _ in firsts}) == len(firsts) and {i for i, _, _ in firsts} == {r.sequence_id for r in got}
        packs.append([(slots[doc], start) for _, doc, start in firsts])
        sequences = defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.doc_id, r.start, r.length))
        packs.append(Counter(tuple(sorted(x)) for x in sequences.values()))
    assert packs[0] == sorted(packs[0]) and packs[2] != sorted(packs[2])
    assert packs[1] == packs[3]  # the same sequences, in another order


def test_rows_are_numbered_over_files_of_any_size(spark, tmp_path):
    """Spark reads large files first and several in a task; positions follow the files' order all the same."""
    rows = [(i, "word " * (3000 if i % 40 > 30 else 3)) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(10, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/t")
    got = packing.pack(spark.read.parquet(f"{tmp_path}/t"), Q.tokenizer_path("byte_bpe_50k.json"), ordered=True).where("offset = 0").collect()
    firsts = [(r.doc_id, r.start) for r in sorted(got, key=lambda r: r.sequence_id)]
    assert firsts == sorted(firsts) and all(r.sequence_id == r.doc_id << 31 | r.start for r in got)


def test_pipeline_on_awkward_rows(spark, data, odd):
    """Nulls, empty and long texts, repeated ids and rows: what each stage does with them, and that all but the last return the columns of documents."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    frame = odd.select(*corpus_pipeline.COLUMNS)
    rows = Counter(map(tuple, frame.collect()))
    results = {name: stage(spark, odd, data) for name, stage in corpus_pipeline.STAGES}
    assert all(r.columns == list(corpus_pipeline.COLUMNS) for r in list(results.values())[:-1])
    assert not Counter(map(tuple, results["quality classifier"].collect())) - rows
    unique = results["near duplicates"].collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in unique if r.doc_id not in (5, 6)) == sorted((k[0] or 0, k[1] or "") for k in rows if k[0] not in (5, 6)) and [r.doc_id for r in unique if r.doc_id in (5, 6)] == [5]
    two = spark.createDataFrame([(1, "a text of more than five words", "en", "b", 1), (1, "something else that has another text altogether", "en", "a", 1), (1, "a text of more than five words", "de", "b", 1)], frame.schema)
    assert sorted((r.text[:4], r.lang) for r in stages["near duplicates"](spark, two, data).collect()) == [("a te", "de"), ("some", "en")]
    masked = results["personal data"].collect()
    assert len(masked) == sum(rows.values()) and sum(r.text is None for r in masked) == sum(k[1] is None for k in rows.elements())
    assert Counter(map(tuple, results["source mixing"].collect())) == rows
    assert results["retrieval packing"].groupBy().agg(F.sum("length")).first()[0] >= sum(rows.values())


def test_shingles_hash_words_over_arrays():
    """Words of any length, white space at the ends and in runs, capitals, and texts cut at several places give a hash for each word, equal for equal words only."""
    rng = random.Random(5)
    words = ["a", "B", "b", "ab", "ba", "aab", "\u00c4", "\u00e4", "\u00a0", "\u2028x", "x\x1c", "y" * 5000, "z" * 5001, "0", "00", "\x00", "\x00\x00"]
    for stretch in (7, 100, 1 << 20):
        before, jaccard_join._STRETCH = jaccard_join._STRETCH, stretch
        try:
            known: dict[bytes, int] = {}
            for _ in range(30):
                chosen = rng.choices(words, k=rng.randrange(0, 12))
                text = (rng.choice(["", " ", "\n\t"]) + "".join(w + rng.choice([" ", "\r\n", "\x0b\x0c", "  "]) for w in chosen)).encode()
                got = jaccard_join.word_hashes(text).tolist()
                said = text.lower().split()
                assert len(got) == len(said)
                assert all(known.setdefault(w, h) == h for w, h in zip(said, got))
            assert len(set(known.values())) == len(known) > 10
        finally:
            jaccard_join._STRETCH = before
    assert len(jaccard_join.shingles(b"a b c d e a b c d e")) == 5 and len(jaccard_join.shingles(b" ")) == 0 and jaccard_join.shingles(b"a B").tolist() == jaccard_join.shingles(b"A\tb ").tolist()
