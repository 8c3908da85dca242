from pyspark.sql import functions as F

from loadwatch.llm.quotes import conversations, op10_quotes, parse

from .conftest import SMALL

TALK = [
    ("c", 0, "Shall we meet on Monday?\nI can bring the plans."), ("c", 1, "An unrelated remark."),
    ("c", 2, "On Monday Ann wrote:\n> Shall we  meet on monday?\nYes, at nine."),
    ("c", 3, "> > Shall we meet on Monday?\n> Yes, at nine.\nNine is too early."),
    ("c", 4, "> Shall we meet on Monday?\n> I can bring the plans.\nPlease do."), ("c", 5, "> nothing of the kind\nA stranger."),
    ("c", 6, "> > > Shall we meet on Monday?\n>> Yes, at nine.\n> Nine is too early.\n> ...\nTen then."),
    ("d", 0, "> Shall we meet on Monday?\nAnother conversation."), ("d", 1, None), (None, 2, "> Another conversation."), ("d", None, "> Another conversation."),
    ("d", 2, "a > b\n  > Another conversation."), ("d", 2, "a > b\n  > Another conversation."),
]
WANT = {("c", 0): (None, 0, 0), ("c", 1): (None, 1, 0), ("c", 2): (0, 0, 1), ("c", 3): (2, 0, 2), ("c", 4): (0, 0, 1), ("c", 5): (None, 5, 0), ("c", 6): (3, 0, 3),
        ("d", 0): (None, 0, 0), ("d", 1): (None, 1, 0), ("d", 2): (0, 0, 1), (None, 2): (None, 2, 0), ("d", None): (None, None, 0)}


def talk(spark):
    return spark.createDataFrame([(*r, "x") for r in TALK], "conv_id string, turn int, text string, depth string").repartition(4)


def test_levels_and_bodies():
    assert parse("a\n> b\n>> c\n> > d\n >e\nf") == ("a\nf", [(1, "b"), (2, "c"), (2, "d"), (1, "e")])
    assert parse("x > y") == ("x > y", []) and parse(None) == ("", [])


def test_links_and_threads(spark):
    out = conversations(talk(spark)).collect()
    assert len(out) == len(TALK)
    assert {(r.conv_id, r.turn): (r.parent_turn, r.thread, r.depth) for r in out} == WANT
    bodies = {(r.conv_id, r.turn): r.body for r in out}
    assert bodies["c", 2] == "Yes, at nine." and bodies["c", 6] == "Ten then." and bodies["d", 2] == "a > b" and bodies["d", 1] == ""
    c = [r.turn for r in out if r.conv_id == "c"]
    assert c == [0, 2, 3, 4, 6, 1, 5]


def test_against_brute_force(spark):
    """Random talk: each message quotes lines of earlier ones; links by trying all earlier messages."""
    import random
    rng, rows = random.Random(9), []
    for conv in range(12):
        bodies = []
        for turn in range(rng.randrange(1, 12)):
            body = [f"line {rng.randrange(25)}" for _ in range(3)]
            quoted = [(1, rng.choice(b)) for b in rng.sample(bodies, min(len(bodies), rng.randrange(3)))]
            bodies.append(body)
            rows.append((conv, turn, "\n".join([*("> " + q for _, q in quoted), *body]), quoted, body))
    got = {(r.conv_id, r.turn): r for r in conversations(spark.createDataFrame([r[:3] for r in rows], "conv_id int, turn int, text string")).collect()}
    parent = {}
    for conv, turn, _, quoted, _ in rows:
        votes = {}
        for _, q in quoted:
            origin = max((t for c, t, _, _, b in rows if c == conv and t < turn and q in b), default=None)
            if origin is not None:
                votes[origin] = votes.get(origin, 0) + 1
        parent[conv, turn] = max(votes, key=lambda o: (votes[o], o)) if votes else None
    for (conv, turn), p in parent.items():
        root, depth = turn, 0
        while parent[conv, root] is not None:
            root, depth = parent[conv, root], depth + 1
        assert (got[conv, turn].parent_turn, got[conv, turn].thread, got[conv, turn].depth) == (p, root, depth)


def test_whole_table_and_empty(spark):
    assert op10_quotes(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/conversations.parquet").count()
    assert conversations(talk(spark).limit(0)).collect() == []
