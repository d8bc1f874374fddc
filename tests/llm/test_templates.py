import random
import re
import time
from collections import Counter

from opinara.llm import templates

ITEM = "If Anna buys 12 apples at 3 kg each and gives Tom 5 of them then how many apples does Anna have left today"
PLAIN = "the quick study of rivers shows that water carries small stones from high hills down into the wide valley below"


def found(spark, docs, items=((1, ITEM), (2, PLAIN))):
    df = spark.createDataFrame(list(docs), "doc_id long, text string")
    rows = templates.leaks(df, spark.createDataFrame(list(items), "item_id long, text string")).collect()
    return {(r.doc_key, r.item_id): (round(r.coverage, 2), r.exact) for r in rows}


def test_templates():
    words = templates.words_of("On 3.5 kg of Éclair it's 1,000 m but kg")
    assert words == ["On", "3.5", "kg", "of", "Éclair", "it", "s", "1,000", "m", "but", "kg"]
    assert templates.template_of(words) == ["N", "0", "U", "of", "N", "it", "s", "0", "U", "but", "kg"]


def test_copies_and_new_parameters(spark):
    renamed = ITEM.replace("Anna", "Maria").replace("Tom", "Ben").replace("12", "40").replace("5", "7").replace("kg", "lbs")
    torn = ITEM.replace("does Anna", "does Eve")
    half = " ".join(PLAIN.split()[:12])
    docs = [
        (1, f"Some words before. {ITEM}. And after."), (2, f"intro {renamed} outro"), (3, torn), (4, PLAIN.upper().lower()), (5, half),
        (6, " ".join(PLAIN.split()[:8])), (7, "nothing of the kind is in this text at all, it only talks"), (8, f"{PLAIN}\n{ITEM}"), (9, None), (10, ""),
    ]
    assert found(spark, docs) == {(1, 1): (1.0, True), (2, 1): (1.0, False), (4, 2): (1.0, True), (5, 2): (0.6, True), (8, 1): (1.0, True), (8, 2): (1.0, True)}


def test_equals_a_search_for_the_items(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_key, r.item_id) for r in templates.leaks(docs, items).where("exact and coverage = 1").collect()}
    words = {r.doc_id: f" {' '.join(templates.words_of(r.text))} " for r in docs.collect()}
    assert got == {(d, r.item_id) for r in items.collect() for d, t in words.items() if f" {' '.join(templates.words_of(r.text))} " in t}
    kept = {r.doc_id for r in templates.clean_documents(docs, items).collect()}
    assert kept == set(words) - {r.doc_key for r in templates.leaks(docs, items).collect()}


def test_edges(spark, edge_docs):
    items = spark.createDataFrame([(None, "two three four five"), (None, "two three four five"), (2, None), (3, ""), (4, "!"), (5, "eight nine ten eleven eight nine x")], "item_id long, text string")
    rows = templates.leaks(edge_docs, items).collect()
    assert sorted((r.doc_key, r.item_id, r.n_words) for r in rows) == [(1, None, 4), (6, None, 4)]
    kept = templates.clean_documents(edge_docs, items)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4, 5] and kept.columns == edge_docs.columns
    for docs, bench in ((edge_docs.limit(0), items), (edge_docs, items.limit(0))):
        assert templates.leaks(docs, bench).count() == 0
    assert templates.clean_documents(edge_docs, items.limit(0)).count() == 8


def test_a_large_benchmark_is_joined(spark, edge_docs, monkeypatch):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    few = sorted(templates.leaks(edge_docs, items).collect())
    monkeypatch.setattr(templates, "MOST_BROADCAST", 0)
    assert sorted(templates.leaks(edge_docs, items).collect()) == few and len(few) == 2


def test_copies_in_another_case(spark):
    title = " ".join(w.capitalize() for w in ITEM.split())
    docs = [(1, ITEM.upper()), (2, f"so {ITEM.lower()} end"), (3, f"x {title}"), (4, PLAIN.upper()), (5, ITEM.upper().replace("12", "40")), (6, "IF ANNA BUYS 12 APPLES THEN SHE HAS 12")]
    whole = {(1, 1): (1.0, False), (2, 1): (1.0, False), (3, 1): (1.0, False), (4, 2): (1.0, False), (5, 1): (1.0, False)}
    assert found(spark, docs) == whole
    assert found(spark, [(1, ITEM), (2, "stra\u00dfe ist hier")], [(1, ITEM.upper()), (2, "STRASSE IST HIER")]) == {(1, 1): (1.0, False), (2, 2): (1.0, False)}


def test_odd_slots(spark):
    short = "Anna likes tea and Anna likes milk"
    docs = [
        (1, ITEM.replace("does Anna", "does Eve")), (2, ITEM.replace("12", "4").replace("5 of", "4 of")), (3, "Anna likes tea and Eve likes milk"),
        (4, ITEM), (5, ITEM.upper().replace("DOES ANNA", "DOES EVE")), (6, "Eve likes tea and Tom likes rain"),
    ]
    rows = templates.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ITEM), (3, short)], "item_id long, text string"), odd=True
    ).collect()
    assert {(r.doc_key, r.item_id): r.n_words for r in rows} == {(1, 1): 23, (2, 1): 24, (3, 3): 6, (4, 1): 24, (5, 1): 20}
    assert templates.odd_places([{"i": 0, "ours": "a", "theirs": "b"}, {"i": 3, "ours": "a", "theirs": "a"}, {"i": 5, "ours": "c", "theirs": "b"}]) == [0]


def brute(doc, item):
    """(words covered, as written) of the best-covered item places over all alignments, by comparing words; None below one half."""
    kind = lambda w: "0" if w[0].isdigit() else "N" if w[0].isupper() else w.casefold()

    def parts(text):
        words = re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+", text or "")
        typed = list(map(kind, words))
        second = ["0" if w[0].isdigit() else w.casefold() for w in words]
        for i in range(1, len(words)):
            if typed[i - 1] == "0" and words[i].lower() in templates.UNITS:
                typed[i] = second[i] = "U"
        return words, typed, second

    (ours, ours_typed, ours_second), (theirs, typed, second) = parts(item), parts(doc)
    n = len(ours)
    width = min(n, 8)
    slot = [t in ("0", "N", "U") for t in ours_typed]
    value = lambda words, i: words[i].casefold()
    total, written = set(), True
    for shift in range(-n, len(theirs)):
        places = []
        for p in range(n - width + 1):
            if p + shift < 0 or p + shift + width > len(theirs):
                continue
            a, b = slice(p, p + width), slice(p + shift, p + shift + width)
            if all(t in ("0", "U") for t in ours_typed[a]):
                hit = ours_typed[a] == typed[b] and [w.casefold() for w in ours[a]] == [w.casefold() for w in theirs[b]]
            else:
                hit = (ours_typed[a] == typed[b] and not all(slot[a])) or ours_second[a] == second[b]
            if hit:
                places.append(p)
        spread = lambda chosen: sorted({i for p in chosen for i in range(p, p + width)})
        whole = spread(places)
        counts = {}
        for i in whole:
            if slot[i]:
                counts.setdefault(value(ours, i), Counter())[value(theirs, i + shift)] += 1
        agree = all(len(c) == 1 for c in counts.values())
        if not agree:
            most = {x: max(c, key=lambda t, x=x, c=c: (c[t], t == x, t)) for x, c in counts.items()}
            odd = {i for i in whole if slot[i] and value(theirs, i + shift) != most[value(ours, i)]}
            own = [i for i in whole if not slot[i] or value(ours, i) == value(theirs, i + shift)]
            rest = spread([p for p in places if not odd & set(range(p, p + width))])
            whole = sorted({*rest, *own}) if len(own) / n >= 0.5 else rest
        if not whole:
            continue
        same = all(value(ours, i) == value(theirs, i + shift) for i in whole)
        literals = sum(not slot[i] or (ours_typed[i] == "N" and value(ours, i) == value(theirs, i + shift)) for i in whole)
        if (agree and same) or literals >= 5:
            total |= set(whole)
            written &= all(ours[i] == theirs[i + shift] for i in whole)
    return (len(total), written) if total and len(total) / n >= 0.5 else None


def test_equals_brute_force_with_odd_slots(spark):
    rng = random.Random(12)
    vocabulary = "the a of rivers small stones then how many does have left".split() + ["Anna", "Tom", "Eve", "3", "5", "12", "1,000", "kg", "m", "PLAIN", "Paris"]
    sentence = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [sentence(rng.choice([3, 6, 9, 14, 30])) for _ in range(12)] + [[str(rng.randint(0, 9)) for _ in range(12)], ["Anna", "Tom", "Eve"] * 4]
    docs = []
    for _ in range(300):
        words = list(rng.choice(items))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        start, end = rng.choice([(0, len(words)), (0, len(words)), (0, max(1, len(words) * 2 // 3))])
        text = " ".join([*sentence(rng.randint(0, 8)), *words[start:end], *sentence(rng.randint(0, 8))])
        docs.append(rng.choice([text, text, text, text.upper(), text.lower()]))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    given = [(i, " ".join(x)) for i, x in enumerate(items)]
    rows = templates.leaks(df, spark.createDataFrame(given, "item_id long, text string"), odd=True).collect()
    expected = {(d, i): found for d, doc in enumerate(docs) for i, item in given if (found := brute(doc, item))}
    assert {(r.doc_key, r.item_id): (r.n_words, r.exact) for r in rows} == expected


def test_names_and_numbers_in_a_row(spark):
    rng = random.Random(13)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6)).capitalize()
    items = [(i, " ".join(name() for _ in range(200))) for i in range(8)] + [(8, " ".join(str(rng.randint(0, 999)) for _ in range(200))), (9, "1 2 3 4 5 6 7 8 9")]
    docs = [(1, " ".join(name() for _ in range(20_000))), (2, " ".join(str(rng.randint(0, 999)) for _ in range(20_000))), (3, items[0][1].upper()), (4, f"x {items[8][1]} y"), (5, "9 8 7 1 2 3 4 5 6 7 8 9")]
    began = time.perf_counter()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = templates.leaks(df, spark.createDataFrame(items, "item_id long, text string"), odd=True).collect()
    assert {(r.doc_key, r.item_id) for r in rows} == {(3, 0), (4, 8), (5, 9)}
    assert time.perf_counter() - began < 60
