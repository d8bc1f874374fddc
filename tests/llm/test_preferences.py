import random

from pyspark.sql import functions as F

from opinara.llm import preferences

TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def rendered(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def spans(turns):
    at, found = 0, []
    for r, t in turns:
        opening, body = len(f"<|{r}|>\n"), len(f"{t}<|end|>\n")
        if r == "assistant":
            found.append(f"{at + opening}:{body}")
        at += opening + body
    return ",".join(found)


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    return n, rendered(chosen[:n]), rendered(chosen[n:]), spans(chosen[n:]), rendered(rejected[n:]), spans(rejected[n:])


def test_equals_brute_force(spark):
    rng = random.Random(8)
    talk = lambda: [(rng.choice(["user", "assistant"]), rng.choice(["a", "😀b", ""])) for _ in range(rng.randint(0, 5))]
    pairs = [(talk(), talk()) for _ in range(300)] + [([("user", "x")],) * 2]
    number = lambda turns: [(i, *t) for i, t in enumerate(turns)]
    rows = [(i, number(c), number(r)) for i, (c, r) in enumerate(pairs)]
    df = spark.createDataFrame(rows, f"pair long, chosen {TURNS}, rejected {TURNS}")
    got = {r.pair: tuple(r[1:]) for r in preferences.format_pairs(df).collect()}
    assert got == {i: brute(*p) for i, p in enumerate(pairs)}


def test_collecting_and_edges(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 1, "user", "A"), (2, None, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "prompt": F.lit(1)})
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in preferences.collect_turns(df).collect()}
    assert got == {1: [(1, "user", "A"), (1, "user", "a"), (2, "assistant", "b")], 2: [(None, "unknown", "")], None: [(0, "user", "x")]}
    unnamed = df.where("conv_id IS NULL").union(df.where("conv_id = 1").withColumn("conv_id", F.lit(None).cast("long")))
    assert sorted(len(r.turns) for r in preferences.collect_turns(unnamed).collect()) == [1, 1, 1, 1]
    none = spark.createDataFrame([(1, None, None)], f"prompt long, chosen {TURNS}, rejected {TURNS}")
    assert [tuple(r) for r in preferences.format_pairs(none).collect()] == [(0, "", "", "", "", "")]
    assert preferences.format_pairs(none.limit(0)).count() == 0
    assert preferences.collect_turns(df.limit(0)).count() == 0
    long = spark.createDataFrame([(i, "assistant" if i % 2 else "user", "t" * 50) for i in range(3000)], "turn long, role string, text string")
    whole = preferences.collect_turns(long.withColumn("conv_id", F.lit(1)))
    chosen, rejected = preferences.with_earlier_reply(F.col("turns"))
    row = preferences.format_pairs(whole.select("conv_id", chosen.alias("chosen"), rejected.alias("rejected"))).first()
    assert row.prompt_turns == 3000 and row.chosen == ""
