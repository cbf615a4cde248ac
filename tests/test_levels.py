"""The level-wise search against the walk, tree by tree."""

import random

from kbspark.operators import levels
from kbspark.operators.navigate import Limits, walk

WORDS = ["red", "blue", "green", "small", "large", "apple", "plum", "sky"]
NODES = "doc_id string, node_id string, parent_id string, type string, title string, summary string, text string, ord int"


def trees(rng, n):
    out = []
    for d in range(n):
        ids = [f"n{d}:0"]
        out.append((f"d{d}", ids[0], rng.choice([None, "gone"]), rng.choice(["document", "section"]), rng.choice(WORDS), None, "", 0))
        for i in range(1, rng.randrange(2, 45)):
            kind = rng.choice(["section", "section", "paragraph", "paragraph", "table"])
            holders = [x for x in ids if x.endswith(("0", "s"))]
            node = f"n{d}:{i}{'s' if kind == 'section' else 'p'}"
            say = lambda k: " ".join(rng.choices(WORDS, k=rng.randrange(0, k)))
            out.append((f"d{d}", node, rng.choice(holders), kind, say(3), rng.choice([None, say(2)]), rng.choice([None, "", say(6), say(6), say(6)]) if kind != "section" else "", rng.randrange(6)))
            ids.append(node)
    return out


def test_the_levels_find_what_the_walk_finds(spark):
    rng = random.Random(8)
    rows = trees(rng, 25)
    nodes = spark.createDataFrame(rows, NODES).repartition(3)
    asked = [(q, f"d{d}", text) for q, text in enumerate(["red apple", "small blue plum sky", "nothing here", "", "green"]) for d in range(26)]
    questions = spark.createDataFrame(asked, "query_id long, doc_id string, query string")
    names = ["doc_id", "node_id", "parent_id", "type", "title", "summary", "text", "ord"]
    for limits in (Limits(), Limits(enough=1, expansions=3, depth=2), Limits(enough=99, leaf_reads=3, depth=6, node_low=0.0)):
        evidence, visits = levels.search(nodes, questions, limits=limits)
        got = {}
        for r in evidence.collect():
            got.setdefault((r.query_id, r.doc_id), []).append((r.node_id, r.text, round(r.score, 9), r.ambiguous, r.is_neighbor))
        seen = {}
        for r in sorted(visits.collect(), key=lambda r: r.visit):
            seen.setdefault((r.query_id, r.doc_id), []).append(r.node_id)
        for q, d, text in asked:
            found, steps = walk([dict(zip(names, r)) for r in rows if r[0] == d], text, limits=limits)
            assert sorted(got.get((q, d), [])) == sorted((f["node_id"], f["text"], round(f["score"], 9), f["ambiguous"], f["is_neighbor"]) for f in found), (q, d)
            assert seen.get((q, d), []) == [s["node_id"] for s in steps if s["action"] == "expand"], (q, d)
