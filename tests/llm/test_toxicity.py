import math

from tidelog.llm import common, toxicity

from .helpers import rows_of, table


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic = got[got.toxic == 1].predicted.mean()
    clean = got[got.toxic == 0].predicted.mean()
    assert toxic > 0.9 and clean < 0.03, (toxic, clean, len(got))


def test_odd_rows(spark):
    rows = [(i, ("you idiot " if i % 3 == 0 else "fine day ") + f"word{i % 7} and word{i % 5} here") for i in range(200)]
    odd = [(900, None), (901, ""), (None, "you idiot"), (902, "unknown"), (903, "you idiot " * 30_000), (903, "you idiot " * 30_000)]
    docs = table(spark, rows + odd)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    got = rows_of(toxicity.score(docs, labels))
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[903]["predicted"] == 1 and by[900]["score"] == by[901]["score"]
    assert sum(by[i]["predicted"] == int(i % 3 == 0) for i in range(200)) > 190


def test_without_labels(spark):
    docs, none = table(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in rows_of(toxicity.score(docs, none))} == {0.0}
    assert toxicity.score(table(spark, []), none).count() == 0


def plain(texts, margin):
    """The models written out in plain Python: (text, toxic or not) -> a function from words to their ratios beyond the margin."""
    docs = [(set(w.decode() for w in toxicity.words_of(t, toxicity.word_table())), mark) for t, mark in texts]
    counts = {}
    for words, mark in docs:
        for w in words:
            for n in range(1, len(w) + 2):
                counts.setdefault((w + " ")[:n], [0, 0])[1 - mark] += 1

    def kneser_ney(table):
        n1, n2 = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        return n1 / (n1 + 2 * n2) if n1 else 0.5

    followed = {}  # (letters before, letter) -> in how many ways they come about
    for p in counts:
        followed.setdefault((p[:-1][-2:], p[-1]), set()).add(p)
    levels = [{k: len(v) for k, v in followed.items()}]
    for k in (1, 0):
        ways = {}
        for s, x in levels[-1]:
            ways.setdefault((s[-k:] if k else "", x), set()).add(s)
        levels.append({key: len(v) for key, v in ways.items()})

    def likely(s, x):
        p = None
        for k, table in enumerate(reversed(levels)):
            here = s[-k:] if k else ""
            if p is not None and len(s) < k:
                here = s
            own = {y: n for (c, y), n in table.items() if c == here}
            d = kneser_ney(table)
            p = (max(own[x] - d, 0) + d * len(own) * (1 / (len(own) + 1) if p is None else p)) / sum(own.values())
        return p

    pooled = {p: sum(c) for p, c in counts.items()}
    d = kneser_ney(pooled)

    def kept(c):
        return max(c - max(0.75, math.sqrt(c)), 0)

    def ratio(word):
        total, full = 0.0, word + " "
        for n in range(1, len(full) + 1):
            h, x = full[: n - 1], full[n - 1]
            kids = [p for p in counts if p[:-1] == h]
            if not kids:
                break
            prob = []
            for mark in (0, 1):
                c = {p: counts[p][mark] for p in kids}
                free = 1 - sum(map(kept, c.values())) / sum(c.values()) if any(c.values()) else 1.0
                prob.append((kept(c.get(h + x, 0)) / sum(c.values()) if any(c.values()) else 0.0, free))
            if h + x in pooled:
                shared = (max(pooled[h + x] - d, 0) + d * len(kids) * likely(h[-2:], x)) / sum(pooled[p] for p in kids)
                total += math.log((prob[0][0] + prob[0][1] * shared) / (prob[1][0] + prob[1][1] * shared))
            else:  # what both spread is the same, so that only its size counts
                total += math.log(max(prob[0][1], 1e-9) / max(prob[1][1], 1e-9))
                break
        return max(total - margin, 0) + min(total + margin, 0)

    return ratio


def corpus():
    import random

    rng = random.Random(6)
    stems = ["mo", "ké", "lu", "ta", "ri"]
    rows = []
    for i in range(150):
        bad = i % 3 == 0
        words = ["".join(rng.choices(stems, k=rng.randrange(1, 4))) for _ in range(8)] + (["zak" + rng.choice(stems)] if bad and rng.random() < 0.9 else []) + (["zarita"] if rng.random() < 0.2 else [])
        rows.append((i, "  ".join(words) + ("!" if bad else ", ") + "q" * (70 if i % 50 == 0 else 2), int(bad)))
    return rows


def test_the_whole_score_against_plain_python(spark):
    import zlib

    rows = corpus()
    docs = table(spark, [r[:2] for r in rows] + [(900, "zak unseen zakmo zz moké"), (901, None)])
    labels = spark.createDataFrame([(i, mark) for i, _, mark in rows], "doc_id long, toxic int")
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _, _ in rows}
    for margin in (0.0, 0.5):
        model = toxicity.train(docs, labels, margin=margin)
        ratio = plain([(t, mark) for i, t, mark in rows if fold[i] > 1], margin)
        have = toxicity.Differences(model)
        words = {w for _, t, _ in rows for w in toxicity.words_of(t, have.table)} | {b"zak", b"unseen", b"zz", "mok\u00e9".encode(), b"m"}
        for w in words:
            assert abs(have[w] - ratio(w.decode())) < 1e-9, w
        for r in rows_of(toxicity.score(docs, labels, model)):
            text = next((t for i, t, _ in rows if i == r["doc_id"]), "zak unseen zakmo zz moké" if r["doc_id"] == 900 else "")
            found = [ratio(w.decode()) for w in toxicity.words_of(text, have.table)]
            n = max(1, len(found))
            z = model.weights @ [1.0, sum(found) / n, sum(found) / math.sqrt(n)]
            assert abs(r["score"] - 1 / (1 + math.exp(-max(min(z, 30), -30)))) < 1e-9


def test_selection_does_not_depend_on_the_ranges(spark):
    words = spark.createDataFrame([(w, t, o) for w, t, o in (("idiot", 60, 0), ("idiom", 0, 50), ("ideal", 1, 80), ("zebra", 2, 90), ("éclair", 9, 0), ("a", 40, 90))], "word string, toxic long, ordinary long")
    rows = toxicity.steps(common.materialize(toxicity.beginnings(words), "test"))
    before, common.partitions = common.partitions, lambda spark: 1
    try:
        one = sorted(map(tuple, toxicity.selected(rows, 0.3).collect()))
        common.partitions = lambda spark: 9
        many = sorted(map(tuple, toxicity.selected(rows, 0.3).collect()))
    finally:
        common.partitions = before
    assert len(one) == len(many) > 5 and all(a == c and abs(b - d) < 1e-9 for (a, b), (c, d) in zip(one, many, strict=True))


def test_long_words_are_read_whole():
    word = "ä" * 100 + "b" * 60
    assert "".join(p.decode() for p in toxicity.words_of(f"x {word} y", toxicity.word_table())) == f"x{word}y"
    assert max(len(p.decode()) for p in toxicity.words_of(word, toxicity.word_table())) == toxicity.LETTERS


def test_table_model_scores_like_a_broadcast_one(spark):
    rows = corpus()
    docs = table(spark, [*[r[:2] for r in rows], (900, None), (901, ""), (None, "zakmo"), (903, "zakmo moké " * 300), (903, "zakmo moké " * 300)])
    labels = spark.createDataFrame([(i, mark) for i, _, mark in rows], "doc_id long, toxic int")
    one, other = (sorted((repr(r["doc_id"]), round(r["score"], 9), r["predicted"]) for r in rows_of(toxicity.score(docs, labels, broadcast=n, margin=0.5))) for n in (10**6, 0))
    assert one == other and len(one) == 155
