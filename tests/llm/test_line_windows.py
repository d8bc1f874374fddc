import random
import time

from opinara.llm import line_windows

BLANKS = " \t\n\x0b\x0c\r"


def brute(docs):
    """docs: (id, text) without repeated rows."""
    seen, gone = set(), {}
    for i, text in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        places = [k for k, x in enumerate(text.split("\n")) if x.strip(BLANKS)]
        lines = [text.split("\n")[k].strip(BLANKS) for k in places]
        for at in range(max(len(lines) - 2, 1)) if lines else ():
            window = tuple(lines[at : at + 3])
            if window in seen:
                gone.setdefault(i, set()).update(places[at : at + 3])
            seen.add(window)
    out = {}
    for i, text in docs:
        lost = gone.get(i, set())
        rest = [x for k, x in enumerate((text or "").split("\n")) if k not in lost]
        left = "\n".join(rest) if any(x.strip(BLANKS) for x in rest) else ""
        out[i] = (text if not lost else left, len(lost))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice(["A", "B", " B ", "C", "", "\t", f"own {rng.random()}"]) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    docs += [(1000, "A\nA\nA\nA\nA"), (1001, "A\nB\nA\nB\nA\nB"), (1002, "one"), (1003, "one"), (1004, " one"), (1005, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_windows.dedup_lines(df).collect()}
    assert got == brute(docs)


def test_a_copy_goes_and_the_first_stays(spark):
    whole = "\n".join(f"line {i} of the passage" for i in range(6))
    rows = [(3, f"start 3\n{whole}\nend 3"), (1, f"start 1\n{whole}"), (2, whole), (4, "start 4\nline 1 of the passage\nend 4")]
    got = {r.doc_id: r.text for r in line_windows.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[1][1], 2: "", 3: "start 3\nend 3", 4: rows[3][1]}


def test_edges(spark, edge_docs):
    rows = line_windows.dedup_lines(edge_docs).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:7], r.n_removed) for r in rows) == [
        (0, "a text ", 0), (1, "one two", 0), (1, "one two", 0), (2, "", 0), (3, "", 0), (4, " \n\t ", 0), (5, "w0x0 w1", 0), (6, "", 1),
    ]
    assert set(line_windows.dedup_lines(edge_docs).columns) == {*edge_docs.columns, "n_removed"}
    assert line_windows.dedup_lines(edge_docs.limit(0)).count() == 0
    same_id = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted(r.text for r in line_windows.dedup_lines(same_id).collect()) in (["a\nb\nc", "d"], ["", "a\nb\nc\nd"])
    many = spark.createDataFrame([(1, "\n".join(f"x{i % 70_000}" for i in range(100_000)))], "doc_id long, text string")
    assert line_windows.dedup_lines(many).first().n_removed == 30_000


def test_time_in_proportion_to_the_lines(spark):
    seconds = []
    for n in (10_000, 10_000, 40_000):
        df = spark.createDataFrame([(1, "\n".join(f"x{i % (n * 7 // 10)}" for i in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        assert line_windows.dedup_lines(df).first().n_removed == n * 3 // 10
        seconds.append(time.perf_counter() - began)
    assert seconds[2] < 8 * seconds[1]
