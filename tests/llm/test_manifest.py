import random
import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from opinara.llm import manifest


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    fields = [*row[:4], text]
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def climb(nodes):
    """All levels over the nodes, the last one with a single node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text"""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[name] = ordered, climb([leaf(r, r[4]) for r in ordered])
    top = climb([trees[s][1][-1][0] for s in names])
    out = []
    for k, name in enumerate(names):
        ordered, levels = trees[name]
        for i, row in enumerate(ordered):
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node, proof = leaf(row, text), ""
            for at, tree in ((i, levels), (k, top)):
                for level in tree[:-1]:
                    run = level[at - at % 3 : at - at % 3 + 3]
                    proof += "".join(x for j, x in enumerate(run) if j != at % 3)
                    node = h("".join(node if j == at % 3 else x for j, x in enumerate(run)))
                    at //= 3
            out.append((row[0], leaf(row, row[4]), levels[-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    result = manifest.document_manifest(df, shown)
    assert result.columns == columns and dict(result.dtypes)["doc_id"] == "bigint"
    return sorted(map(tuple, result.collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(13)
    sizes = {"a": 3000, "b": 729, "c": 730, "d": 1, "é": 2, "": 40, None: 9, "B": 28}
    rows = [(i, s, rng.choice(["en", None]), rng.randint(0, 9), rng.choice(["x\ny", "\n", "ü", "", None, f"t{i}"])) for s, n in sizes.items() for i in rng.sample(range(10**12), n)]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_one_group_and_many_groups(spark):
    one = [(i, "s", "en", 1, f"t\n{i}") for i in range(5)]
    many = [(i, f"s{i}", "en", 1, f"t\n{i}") for i in range(900)]
    for rows in (one, many, one[:1]):
        assert found(spark, rows) == brute(rows)


def test_edges(spark, edge_docs):
    rows = [(None, None, None, None, None), (2**62 + 1, "s", None, None, "a\nb"), (7, "s", "x", 1, "same\n"), (7, "s", "x", 1, "same\n"), (None, "s", "x", 1, "y"), (7, "s", "x", 1, "other")]
    rows.append((8, "s", "x", 1, "long \n" * 200_000))
    assert found(spark, rows) == brute(rows)
    docs = edge_docs.withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(None).cast("long"))
    assert manifest.document_manifest(docs).count() == 8
    assert manifest.document_manifest(docs).where("not verified").count() == 0
    assert manifest.document_manifest(docs.limit(0)).count() == 0
