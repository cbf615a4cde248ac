"""Nested exports, dependencies to a fixpoint, questions asked before, and chunks bounded by tokens, against brute force."""

import json
import random
import re

from kbspark.operators import chunking, export, requirements

NODES = "doc_id string, node_id string, parent_id string, title string, ord int"


def test_nested_json(spark):
    rng = random.Random(1)
    rows = []
    for d in range(8):
        ids = []
        for i in range(rng.randrange(1, 30)):
            rows.append((f"d{d}", f"n{i}", rng.choice([*ids, None, "gone"]) if ids else None, rng.choice([None, 'q"uo\\te', "é"]), rng.randrange(4)))
            ids.append(f"n{i}")
    rows += [("chain", f"c{i}", f"c{i - 1}" if i else None, "t", 0) for i in range(1000)]
    got = {r.doc_id: r.json for r in export.nested_json(spark.createDataFrame(rows, NODES).repartition(3), ["node_id", "title"]).collect()}

    def plain(doc, parent):
        ids = {r[1] for r in rows if r[0] == doc}
        below = sorted((r[4], r[1], r[3]) for r in rows if r[0] == doc and (r[2] if r[2] in ids else None) == parent)
        return [{"node_id": k} | ({"title": t} if t is not None else {}) | {"children": plain(doc, k)} for _, k, t in below]

    for d in range(8):
        assert json.loads(got[f"d{d}"]) == plain(f"d{d}", None)
    chain = got["chain"]
    assert chain.count('"children":[') == 1000 and chain.endswith("]}" * 1000 + "]") and [int(x) for x in re.findall(r'"c(\d+)"', chain)] == list(range(1000))
    assert export.nested_json(spark.createDataFrame([], NODES), ["title"]).count() == 0


def test_requirements_settle(spark):
    rng = random.Random(6)
    base = [(f"b{i}", rng.choice(["SUPPORTED", "SUPPORTED", "SUPPORTED", "PARTIAL", None])) for i in range(12)]
    rows = [(f"s{i}", True, rng.sample([*(b[0] for b in base), *(f"s{j}" for j in range(i))], min(i + 3, rng.randrange(1, 4))) * 2) for i in range(60)]
    rows += [("x", True, ["y"]), ("y", True, ["x", "b0"]), ("behind", True, ["y"]), ("self", True, ["self"]), ("none", True, None), ("gone", True, ["nothing"]), ("after", True, ["none"]), ("b0", False, None)]
    got = {r.id: r.state for r in requirements.resolve(spark.createDataFrame(rows, "id string, synthetic boolean, deps array<string>"), spark.createDataFrame(base, "id string, status string")).collect()}
    done = {b for b, s in base if s == "SUPPORTED"}
    for i, _, deps in rows[:60]:
        if set(deps) <= done:
            done.add(i)
    expected = {i: "supported" if i in done else "waiting" for i, synthetic, _ in rows if synthetic}
    expected |= dict.fromkeys(("x", "y", "behind", "self"), "cycle")
    assert got == expected and {"supported", "waiting"} <= set(expected.values())


def test_requirements_are_settled_in_one_pass_that_moves_only_what_waits(spark, monkeypatch):
    moved = []

    def stored(df, path, write=requirements.stored):
        out = write(df, path)
        moved.append(out.count())
        return out

    monkeypatch.setattr(requirements, "stored", stored)
    rows = [(f"a{i}", True, ["b", None][: 1 + (i == 0)]) for i in range(50)] + [(f"c{i}", True, [f"c{i - 1}" if i else "b"]) for i in range(5)] + [("w0", True, ["p"]), ("w1", True, ["w0", "b"])]
    got = {r.id: r.state for r in requirements.resolve(spark.createDataFrame(rows, "id string, synthetic boolean, deps array<string>"), spark.createDataFrame([("b", "SUPPORTED"), ("p", "PARTIAL")], "id string, status string")).collect()}
    assert got == {i: "waiting" if i in ("w0", "w1") else "cycle" if i == "a0" else "supported" for i, _, _ in rows}
    # the requirements, what they wait for, and then what still waits in each round
    assert moved == [57, 57, 6, 4, 3, 2, 1]


def test_questions_asked_before(spark):
    rng = random.Random(12)
    rows = [(c, t, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 9)))) for c in range(20) for t in range(40)]
    terms = {(c, t): frozenset(x.split()) for c, t, x in rows}
    for alike, newest in ((0.9, 32), (0.5, 5)):
        expected = []
        for c, t, _ in rows:
            a = terms[c, t]
            near = [(len(a & b) / len(a | b), s) for s in range(max(0, t - newest), t) if a and (b := terms[c, s])]
            if near and max(near)[0] >= alike:
                expected.append((c, t, max(near)[1], round(max(near)[0], 6)))
        got = requirements.asked_before(spark.createDataFrame(rows, "conv_id long, turn int, text string").repartition(3), alike, newest)
        assert sorted(map(tuple, got.collect())) == sorted(expected)


def plain_chunks(text, most):
    token = re.compile(r"\s*(?:[一-鿿぀-ヿ가-힯]|[^\s一-鿿぀-ヿ가-힯]+)(?:\s+$)?")
    pieces = []
    for p in re.findall(r"[^。！？!?；;\n]*[。！？!?；;\n]+|[^。！？!?；;\n]+", text):
        t = token.findall(p)
        pieces += [("".join(t[i : i + most]), len(t[i : i + most])) for i in range(0, len(t), most)] if len(t) > most else [(p, len(t))]
    out, used = [], 0
    for p, n in pieces:
        if out and used + n <= most:
            out[-1] += p
            used += n
        else:
            out.append(p)
            used = n
    return out


def test_chunks_by_tokens(spark):
    rng = random.Random(7)
    texts = [None, "", "  ", "a", "中文字。很多！\n\n", "one " * 100, "。" * 30] + ["".join(rng.choices(["ab", " ", "\n", "中", "。", "x! ", "\t", ";", "word "], k=rng.randrange(1, 300))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for most in (1, 5, 16):
        got = {r.i: r.c for r in df.select("i", chunking.token_chunks(df["text"], most).alias("c")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == plain_chunks(t or "", most), (most, t)
            assert "".join(got[i]) == (t or "") and all(len(re.findall(r"[一-鿿]|[^\s一-鿿]+", c)) <= most for c in got[i])
