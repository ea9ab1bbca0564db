"""The operators against brute force on small tables, and on odd ones."""

import hashlib
import html as html_lib
import random
import re
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, edits, graph, html_text, langid, licenses, line_dedup, mixing, near_dedup, pii, quality, queries, url_rules

SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(licenses.UPPER, licenses.LOWER)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, bucket int, words int, size int, kept int, row int, line int, body int, base int, lines int, __none int"


def odd_rows():
    """Nulls in every column, empty and blank texts, repeated rows, ties, a very long text, clashing extra columns."""
    long = " ".join(f"word{i % 997}" for i in range(30000)) + "\n" + "a" * 50000
    texts = [None, "", " \t\n ", "one", "one", "The MIT License here", "the of and to", "é" * 300, long, "x y z\nx y z\n\nx y z", "+1 (555) 010-9999 a@b.co 4111 1111 1111 1111 1.2.3.4"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "n", 1, 2, 3, 4, 5, 6, 7, 8, 9, 0) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[9], (None, "one", None, None, None) + (None,) * 11, (None, None, None, None, None) + (None,) * 11]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_odd_tables(spark, odd, sf_dir):
    benchmark = spark.createDataFrame([(1, "x y z"), (2, None), (None, "one"), (1, "x y z")], "item_id long, text string")
    for table, n in ((odd, odd.count()), (odd.limit(0), 0)):
        for run in (
            line_dedup.summary,
            lambda t: decontaminate.contamination(t, benchmark),
            lambda t: decontaminate.contamination(t, benchmark.limit(0)),
            quality.judge,
            langid.identify,
            near_dedup.near_duplicates,
            lambda t: pii.digest(pii.find(t)),
            licenses.scan,
            mixing.mix,
        ):
            assert len(run(table).collect()) == n
        assert quality.filtered(table).columns == line_dedup.deduplicate(table).columns == near_dedup.deduplicate(table).columns == table.columns
        for run in (quality.filtered, line_dedup.deduplicate, near_dedup.deduplicate, lambda t: decontaminate.clean(t, benchmark), mixing.mixture):
            assert len(run(table).collect()) <= n


def test_odd_pages(spark):
    rows = [(1, None, None, 0), (2, "no scheme", "", 1), (None, "http://A.Example.ORG/es/x", "<p>a &amp; b", 2), (4, "http://a.com/de/", "<div", 3), (4, "http://a.com/de/", "<div", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert html_text.extract(pages).count() == 5 and html_text.extract(pages.limit(0)).count() == 0
    got = {r["page_id"]: r for r in url_rules.judge(pages).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == ("", "", None)
    assert (got[None]["host"], got[None]["path"], got[None]["verdict"]) == ("a.example.org", "/es/x", "block")
    assert got[4]["rule"] == "com/de/" and url_rules.judge(pages.limit(0)).count() == 0


def test_quality_base(docs):
    judged = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t in texts_of(docs):
        w = SPACE_WORD.findall(t)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        r = judged[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_good_documents(spark, docs, sf_dir):
    both = quality.judge(docs).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("NOT base_failed")
    good = both.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = both.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.98 and (bad is None or bad < 0.6)


def test_js_distance(spark):
    p, q = F.lit([1.0, 0.0]), F.lit([0.0, 3.0])
    r = spark.range(1).select(quality.js_distance(p, q), quality.js_distance(p, p), quality.js_distance(p, F.lit([0.0, 0.0]))).first()
    assert tuple(round(x, 9) for x in r) == (1.0, 0.0, 0.0)


def test_contamination(spark, docs, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").union(spark.createDataFrame([(900, "the of"), (901, "the of and"), (902, "")], "item_id long, text string"))
    items = texts_of(bench.withColumnRenamed("item_id", "doc_id"))
    windows, sizes = {}, set()
    for i, t in items:
        w = ALNUM_WORD.findall((t or "").translate(LOWER))
        m = min(13, len(w))
        for p in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + m]), set()).add(str(i))
            sizes.add(m)
    for options in ({}, {"max_block_bytes": 1000, "shard_bytes": 5000}):
        got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench, **options).collect()}
        for i, t in texts_of(docs):
            w = ALNUM_WORD.findall(t.translate(LOWER))
            hit, found = set(), set()
            for m in sizes:
                for p in range(len(w) - m + 1):
                    if x := windows.get(tuple(w[p : p + m])):
                        hit |= set(range(p, p + m))
                        found |= x
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_family(n=60, seed=5):
    """Copies of one text with more and more words replaced, among unrelated texts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(i % 12):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(n + i, " ".join(f"u{rng.randrange(5000)}" for _ in range(80))) for i in range(40)] + [(n + 40, rows[3][1]), (n + 41, "A b"), (n + 42, "a B")]
    return rows


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates(spark, shingle):
    rows = near_family()
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.Plan(shingle=shingle)).collect()}
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or {tuple(w)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(links, sets)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (want[i] == i) for i in sets)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(100)] + [(0, 299)]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = {r["u"]: r["v"] for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = brute_components(pairs, {x for p in pairs for x in p})
    assert got == {n: r for n, r in want.items() if n != r}


def simhash(words, hashes):
    n = [sum(hashes[w] >> k & 1 for w in words) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * n[k] > len(words))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances_in_batches():
    """Batched, bounded edit distances against the textbook table, at block borders and beyond ASCII."""
    rng = random.Random(1)
    left, right = ["", "", "a", "same"], ["", "a", "", "same"]
    for _ in range(300):
        n = rng.choice([1, 5, 30, 63, 64, 65, 128, 200, 260, 400])
        a = [rng.choice("abcdé漢") for _ in range(n)]
        b = list(a)
        for _ in range(rng.choice([n // 8, n // 5, n // 4, n])):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "cd"])
        left.append("".join(a))
        right.append("".join(b))
    want = [edit_distance(a, b) <= int((1 - 0.8) * max(len(a), len(b)) + 1e-9) for a, b in zip(left, right, strict=True)]
    assert edits.within(pa.array(left), pa.array(right), 0.8).tolist() == want
    assert 0.1 < sum(want) / len(want) < 0.9
    assert edits.within(pa.array([], pa.string()), pa.array([], pa.string()), 0.8).tolist() == []


def test_line_dedup(spark):
    rng = random.Random(8)
    base = [f"tok{rng.randrange(400)}" for _ in range(60)]
    lines = []
    for i in range(24):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(60)] = f"new{rng.randrange(10**5)}"
        lines.append(" ".join(w))
    lines += [" ".join(f"o{rng.randrange(300)}" for _ in range(20)) for _ in range(10)]
    rows = [(i, f"{lines[i]}\n{lines[(i * 7 + 1) % len(lines)].upper()}!\n\nab") for i in range(len(lines))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    norm = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()
    spots = [((i, k), norm(x)) for i, t in rows for k, x in enumerate(t.split("\n")) if len(norm(x).split()) >= 3]
    words = sorted({w for _, x in spots for w in x.split()})
    hashes = {r["w"]: r["h"] & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    kinds = sorted({x for _, x in spots})
    print_of = {x: simhash(x.split(), hashes) for x in kinds}
    links = [
        (a, b) for a in range(len(kinds)) for b in range(a)
        if (print_of[kinds[a]] ^ print_of[kinds[b]]).bit_count() <= 3 and edit_distance(kinds[a], kinds[b]) <= int(0.2 * max(len(kinds[a]), len(kinds[b])) + 1e-9)
    ]
    assert links
    group = brute_components(links, range(len(kinds)))
    keeper = {}
    for spot, x in spots:
        g = group[kinds.index(x)]
        keeper[g] = min(keeper.get(g, spot), spot)
    want = {i: set() for i, _ in rows}
    for spot, x in spots:
        if keeper[group[kinds.index(x)]] != spot:
            want[spot[0]].add(spot[1])
    got = {r["doc_id"]: {int(k) for k in r["dropped"].split(",") if k} for r in line_dedup.summary(df).collect()}
    assert got == want
    kept = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(df, drop_emptied=False).collect()}
    assert kept == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in rows}


def test_line_dedup_by_edit_similarity(spark):
    """Groups by edit similarity alone, with one changed word or letter at every length; rarely by a few more."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    rows = []
    for n in (6, 8, 10, 15, 25, 40, 80):
        for _ in range(3):
            base = [word() for _ in range(n)]
            short = min(range(n), key=lambda k: len(base[k]))
            changed = [w[::-1] + "x" if k == short else w for k, w in enumerate(base)]
            letter = " ".join(base)
            rows += [" ".join(base), " ".join(changed), letter[:7] + ("q" if letter[7] != "q" else "z") + letter[8:] if letter[7] != " " else letter[:8] + "qq" + letter[9:]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    links = [(a, b) for a in range(len(rows)) for b in range(a) if edit_distance(rows[a], rows[b]) <= int(0.2 * max(len(rows[a]), len(rows[b])) + 1e-9)]
    group = brute_components(links, range(len(rows)))
    assert len(set(group.values())) <= 24
    got = {r["doc_id"] for r in line_dedup.summary(df, max_distance=None).where("n_dropped = 1").collect()}
    assert got == {i for i in group if group[i] != i}


def test_short_lines_in_query_and_pipeline(spark, tmp_path):
    """Repeats of lines of one or two words, and of a sentence without spaces, are dropped; a line without a word stays."""
    import corpus_pipeline

    rows = [(0, "and ornd\nthe first line stays\n--"), (1, "And ornd!\nanother one is here\n--"), (2, "\u4eca\u65e5\u306f\u96e8"), (3, "x\n\u4eca\u65e5\u306f\u96e8"), (4, "y\nX")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["dropped"] for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: "", 1: "0", 2: "", 3: "1", 4: "1"}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, docs, str(tmp_path)).collect()}
    assert kept == {0: rows[0][1], 1: "another one is here\n--", 2: rows[2][1], 3: "x", 4: "y"}


def test_long_and_repeated_lines(spark):
    """Lines beyond 32,767 words have signatures and meet their near copies; repeated rows do not add up or overflow."""
    rng = random.Random(4)
    long = [rng.choice("abcdefgh") for _ in range(70_000)]
    short = [f"w{i}" for i in range(20)]
    lines = [long, [*long[:-1], "z"], short]
    df = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(lines[1]))] + [(None, " ".join(short))] * 5000, "doc_id long, text string")
    words = sorted({w for x in lines for w in x})
    hashes = {r["w"]: r["h"] & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    assert sorted(r["simhash"] & (2**64 - 1) for r in line_dedup.simhashes(df, 5).collect()) == sorted(simhash(x, hashes) for x in lines)
    met = [set(r["buckets"]) for r in line_dedup.minhashes(df, 5).collect()]
    assert len(met) == 3 and sorted(bool(a & b) for i, a in enumerate(met) for b in met[:i]) == [False, False, True]


def test_pii_base(docs):
    extra = [(-1, "x@y@z.co a..b@c-d.e.f%g@h.i +1 2 3 4 5 6 7 8 9 1.2.3.4.5.6 999.1.1.1 4111-1111-1111-1111 0000000000000000 12 34 @a.b"), (-2, "1" * 3000 + "@" + "a" * 3000)]
    rows = texts_of(docs) + extra
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(df)).collect()}
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10 == 0
    for i, t in rows:
        s = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        s += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        s += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        s += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
        s.sort(key=lambda x: (x[1], pii.KINDS.index(x[0])))
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in s).encode()).hexdigest(), i


def test_pii_checksums():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert [s[0] for s in pii.spans("pay to IBAN GB82 WEST 1234 5698 7654 32 please")] == ["iban"]
    assert pii.spans("order 123-45-6789") == [] and [s[0] for s in pii.spans("SSN 123-45-6789")] == ["ssn"]


def test_license_base(docs):
    extra = [(-1, "CC BY cc by-NC mit license MIT LICENSE"), (-2, "gnu general public"), (-3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this new software and associated documentation files")]
    rows = texts_of(docs) + extra
    got = {r["doc_id"]: r for r in licenses.scan(docs.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = ALNUM_WORD.findall(t.translate(LOWER))
        found = [(k, label) for p, label in licenses.PHRASES for q in [p.split()] for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(found), ",".join(sorted({x for _, x in found})))
        assert (r["first_word"], r["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not found
    assert got[-3]["labels"] == "mit" and got[-3]["n_base"] == 0


def test_license_spans(spark):
    """A notice is found with words put in, left out or changed, and at its place; not when its word pairs lie scattered."""
    notice = licenses.NOTICES[5][0].split()
    pairs = [f"{a} {b}" for a, b in zip(notice, notice[1:], strict=False)]
    texts = {
        "whole": "x " * 50 + " ".join(notice) + " y" * 50,
        "put in": " ".join([*notice[:8], "and", "also", *notice[8:]]),
        "left out": " ".join(notice[:6] + notice[8:]),
        "changed": " ".join([*notice[:5], "other", *notice[6:]]),
        "twice": " ".join([*notice, "and then again", *notice]),
        "filler": " filler ".join(pairs),
        "mixed up": " ".join(sorted(pairs)),
        "half": " ".join(notice[: len(notice) // 2]),
        "apart": " ".join(notice[:10] + ["word"] * 40 + notice[10:]),
    }
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert {k for k, r in got.items() if r["labels"] == "bsd"} == {"whole", "put in", "left out", "changed", "twice"}
    assert got["whole"]["score"] == 1.0 and got["filler"]["score"] == 0.0 and {k: r["n_words"] for k, r in got.items()} == {k: len(t.split()) for k, t in texts.items()}


def test_clashing_names(spark):
    """Columns of docs may have any name, those of inner columns included."""
    names = ["__lines", "__body", "__id", "__mix", "__source", "size", "taken", "row", "body", "__in_0"]
    rows = [(k, t, "s", *[f"{n}{k}" for n in names]) for k, t in enumerate(["one two three four five six\nseven", "one two three four five six\neight", "nine"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = {r["doc_id"]: r for r in line_dedup.deduplicate(docs, min_words=1, max_distance=None).collect()}
    assert [out[k]["text"] for k in range(3)] == [rows[0][1], "eight", "nine"] and all(tuple(out[k])[2:] == rows[k][2:] for k in range(3))
    mixed = {r["doc_id"]: r.asDict() for r in mixing.mixture(docs).collect()}
    assert {k: r["taken"] for k, r in mixed.items()} == {0: 7, 1: 7, 2: 1} and all(r[n] == f"{n}{k}" for k, r in mixed.items() for n in names if n not in ("size", "taken"))


def test_language_id(docs):
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", langid.is_held_out(F.col("doc_id"))).where("held")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_mixing(duck, docs, spark, sf_dir):
    ours = sorted(tuple(r) for r in queries.op10_mix_sources(spark, sf_dir).collect())
    assert ours == sorted(duck.execute(mixing.ORACLE).fetchall())
    for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert abs(r["t"] - r["target"]) < 1 and r["over"] <= 0


def test_html(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op9_html_text(spark, sf_dir).collect():
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = (" ".join(html_lib.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1|div)[^>]*>", article))
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_html_parts():
    page = """<body><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies to make this site better for all of our readers.</p></div>
    <div id=main><h2>A title of some length here</h2><p>First &eacute;t&eacute; paragraph with <a href=x>one link</a> and some more words in it.</p>
    <p>Second paragraph, which is long enough &lt;to&gt; stay where it is in this text.</p></div>
    <aside><p>Another story that is quite long but stands at the side of the page.</p></aside>
    <section class="comments"><p>I liked this article a lot, thank you for writing it my friend.</p></section>
    <form><p>Subscribe to our letter and never miss a single story of ours again.</p></form><footer>&copy; me</footer><script>var a="<p>no</p>"</script>"""
    got = html_text.main_text(page, html_text.trained_tree()).split("\n\n")
    assert got == ["A title of some length here", "First été paragraph with one link and some more words in it.", "Second paragraph, which is long enough <to> stay where it is in this text."]


def test_html_elements_apart():
    """Text beside, after and around elements that are set apart stays; data- attributes mean nothing; tags may be left open."""
    tree = html_text.trained_tree()
    read = lambda body: html_text.main_text(f"<html><body>{body}</body></html>", tree).split("\n\n")
    more = "and some more words that make this a paragraph of usual length in an article"
    assert read(f"<article><p>One <span class='ad'>buy <b>now</b></span> two {more}.</p><p>Three {more}.</p></article>") == [f"One two {more}.", f"Three {more}."]
    assert read(f"<article><p>One <span class='ad'><span>buy</span> now</span> two {more}.</p></article>") == [f"One two {more}."]
    assert read(f"<article><p class='ad'>buy</p>bare text {more}</article>") == [f"bare text {more}"]
    assert read(f"<div class='content-sidebar-wrap'><article><p>One {more}.</p></article></div>") == [f"One {more}."]
    assert read(f"<div class='sidebar'><p>Aside {more}.</p></div><article><p>One {more}.</p></article>") == [f"One {more}."]
    assert read(f"<article data-id='ad' data-role='banner'><p data-class='ad'>One {more}.</p></article>") == [f"One {more}."]
    assert read(f"<article><ul><li>One {more}<li>Two {more}</ul><p>Three {more}<p class=ad>Buy<p>Four <b>{more}</article>") == [f"One {more}", f"Two {more}", f"Three {more}", f"Four {more}"]
    assert read(f"<article><p>One <b>two <i>three</b> four</i> {more}</p></article><form><p>Send {more}</p></form>") == [f"One two three four {more}"]
    long = " ".join(f"w{i}" for i in range(200_000))
    assert read(f"<article><p>{long}</p></article>") == [long]


WORDS = "this sentence has some words that a reader of the page would like to see in the text of the article".split()


def some_words(n, first):
    return " ".join([first, *(WORDS[k % len(WORDS)] for k in range(n - 1))])


def test_html_tree_on_its_table():
    table, tree = html_text.labelled_table(), html_text.trained_tree()
    right = sum(html_text.classify(tree, list(r[:-1])) == bool(r[-1]) for r in table)
    assert len(table) > 200 and right / len(table) > 0.96


def test_html_apart_from_the_article():
    """Comments, related stories, adverts and menus go by their names, whatever other words or articles are in them."""
    tree = html_text.trained_tree()
    read = lambda body: html_text.main_text(f"<html><body>{body}</body></html>", tree).split("\n\n")
    one, two, other = some_words(24, "First"), some_words(31, "Second"), some_words(20, "Other")
    article = f"<article><p>{one}</p><p>{two}</p></article>"
    for apart in (
        f"<div class='post-comments'><p>{other}</p></div>",
        f"<section class='comment-content'><p>{other}</p></section>",
        f"<div class='story-related'><p>{other}</p></div>",
        f"<div class='relatedPosts'><article><p>{other}</p></article></div>",
        f"<div class='ad-container'><p>{other}</p></div>",
        f"<div id='comments'><article class='comment-body'><p>{other}</p></article></div>",
        f"<ol class='commentlist'><li><article><p>{other}</p></article></ol>",
        f"<div class='main-sidebar'><p>{other}</p></div>",
        f"<div class='page-footer'><p>{other}</p></div>",
        f"<div class='notice'><p>{other}</p></div>",
        "<div><a href='/'>Home</a></div><div><a href='/n'>News</a></div><div><a href='/a'>About us</a></div>",
        "<ul><li><a href='/'>Home</a><li><a href='/n'>News</a><li><a href='/a'>About us</a></ul>",
    ):
        assert read(apart + article) == [one, two] and read(article + apart) == [one, two], apart
        if "<article" not in apart and "href" not in apart and "notice" not in apart:
            assert read(f"<article><p>{one}</p>{apart}<p>{two}</p></article>") == [one, two], apart
    assert read(f"<div class='has-sidebar with-comments'>{article}</div>") == read(f"<form>{article}</form>") == [one, two]
    assert read(f"<div class='no-sidebar'><p>{one}</p><p>{two}</p></div>") == [one, two]


def test_html_short_parts_of_an_article():
    tree = html_text.trained_tree()
    read = lambda body: html_text.main_text(f"<html><body>{body}</body></html>", tree).split("\n\n")
    menu = "<div><a href='/'>Home</a></div><div><a href='/n'>News</a></div>"
    one, linked = some_words(24, "First"), some_words(9, "Linked")
    for short in ("It was a very good day.", "Yes.", "No, never."):
        assert read(f"<article><p>{one}</p><p>{short}</p></article>{menu}") == [one, short]
        assert read(f"{menu}<article><p>{short}</p><p>{one}</p></article>") == [short, one]
        assert read(f"<article><p>{short}</p><p>{short}</p></article>") == [short, short]
    assert read(f"<article><p>{one}</p><p><a href='/x'>{linked}</a></p></article>{menu}") == [one, linked]
    assert read(f"<article><p>{one}</p><p class='notice'>{linked}</p></article>") == [one, linked]


TEMPLATES = [
    "<div class='main'><ul><li><a>Home</a><li><a>World</a><li><a>About us</a></ul>{}<p class='copyright'>By us</p></div>",
    "<ul><li><a>Home</a><li><a>World</a><li><a>About us</a></ul><div id='content'>{}</div><div id='footer'><p>All rights reserved by the owner of this site</p></div>",
    "<div><a>Home</a></div><div><a>News</a></div><div><a>Sport</a></div><div><a>About us</a></div>{}<div><a>Terms</a></div><div><a>Privacy</a></div>",
    "<main>{}</main><div class='related'><h3>Read more</h3><p>Another story that readers of this one have liked very much</p></div>",
    "<div class='topnav navbar'><p>Menu</p></div><div class='entry-content'>{}</div><div id='comments'><h3>Two comments</h3><p>I liked this very much and will read all of it again</p></div>",
    "<table><tr><td><a>Home</a><td><a>Archive</a><td><a>Contact</a></table><div>{}</div>",
    "<header><h1>The Daily Page</h1><p>News of every day since nineteen hundred and one</p></header><section>{}</section><footer><p>Made by us</p></footer>",
    "<div role='banner'><p>The Page of the Day</p></div><div role='main'>{}</div><div role='contentinfo'><p>Contact us by mail</p></div>",
    "<div class='cookie-consent'><p>We use cookies so that this site works well for each of our readers</p></div>{}<aside><p>At the side of the page stands this story</p></aside>",
    "<form><p>Search the site</p><input></form><div class='post'>{}</div><div class='sidebar'><p>An author who writes here each day of the week</p></div>",
    "<dialog><p>Sign up for the letter of the week and miss nothing</p></dialog><div>{}</div><ul><li><a>Privacy policy</a><li><a>Terms of use</a><li><a>Our team</a></ul>",
]


@pytest.mark.parametrize("template", TEMPLATES)
def test_html_pages_without_article(template):
    """What stands in the place of {} is the text, block by block, and nothing else of the page is."""
    tree = html_text.trained_tree()
    rng = random.Random(3)
    for _ in range(25):
        want = [some_words(rng.randrange(4, 10), "Title"), *(some_words(rng.choice([8, 12, 20, 45, 80]), f"P{k}") for k in range(rng.randrange(2, 7)))]
        body = f"<h1>{want[0]}</h1>" + "".join(f"<p>{p}</p>" for p in want[1:])
        page = "<html><body>" + template.replace("<a>", "<a href='/x'>").format(body) + "</body></html>"
        assert html_text.main_text(page, tree).split("\n\n") == want


def test_url_rules(spark, sf_dir):
    rows = url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in rows:
        rest = urls[r["page_id"]].split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [(len(rule), rule, v) for v, rule in url_rules.RULES for h, p in [rule.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert (r["host"], r["path"], r["rule"]) == (host.lower(), path, max(fits)[1] if fits else None)
        assert not fits or r["verdict"] == max(fits)[2]


def test_mined_rules(spark):
    rows = [(i, f"http://a{i % 5}.com/{'de' if i % 2 else 'fr'}/bad{'' if i % 2 else 'ly'}") for i in range(100)] + [(1000, "http://z.net/x/bad"), (1001, "http://z.net/x/badly"), (1002, "http://z.net/other")]
    got = {r["page_id"]: r for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1000]["verdict"] == "block" and got[1000]["mined_confidence"] == 1.0
    assert got[1001]["verdict"] == "allow" and got[1002]["mined_confidence"] is None


def mined_by_hand(rows, m):
    """page_id -> (verdict, confidence): every subset of the tokens of an open URL is looked up among all labelled ones."""
    labelled = [(set(r["tokens"]), r["verdict"]) for r in rows if r["verdict"]]
    least = -(-len(labelled) * m.min_support // 1)
    held = defaultdict(int)
    for k, (tokens, _) in enumerate(labelled):
        for t in tokens:
            held[t] |= 1 << k
    blocks = sum(1 << k for k, (_, v) in enumerate(labelled) if v == "block")
    out = {}
    for r in rows:
        if r["verdict"]:
            continue
        best = None
        sets = [((), (1 << len(labelled)) - 1)]
        for t in r["tokens"]:
            sets += [((*s, t), both) for s, at in sets if (both := at & held[t]).bit_count() >= least]
        for s, at in sets[1:]:
            for verdict, hits in (("block", at & blocks), ("allow", at & ~blocks)):
                share = hits.bit_count() / at.bit_count()
                if hits.bit_count() >= least and share >= m.min_confidence:
                    best = max(best or (0, 0, False, ""), (share, hits.bit_count(), verdict == "block", verdict))
        out[r["page_id"]] = (best[3], best[0]) if best else ("allow", None)
    return out


def tokens_and_labels(pages):
    rule, verdict = url_rules.decided(url_rules.RULES)
    read = pages.select("page_id", "url", url_rules.host_of(F.col("url")).alias("host"), url_rules.path_of(F.col("url")).alias("path"))
    return read.select("page_id", verdict.alias("verdict"), url_rules.tokens_of(F.col("url")).alias("tokens")).collect()


@pytest.mark.parametrize("support,confidence", [(0.01, 0.8), (0.03, 0.55)])
def test_mined_verdicts_by_hand(spark, support, confidence):
    """All verdicts on the pages of sf0.01 that the rule list leaves open."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    m = url_rules.Mining(min_support=support, min_confidence=confidence)
    want = mined_by_hand(tokens_and_labels(pages), m)
    got = {r["page_id"]: (r["verdict"], r["mined_confidence"]) for r in url_rules.judge(pages, mining=m).collect()}
    assert len(want) > 100 and {i: got[i] for i in want} == want


def test_mixed_rules_by_hand(spark):
    """Combinations whose tokens go with both labels, tokens that always stand together, and ties."""
    rng = random.Random(9)
    words = [f"w{c}" for c in "abcdefg"]
    rows = [(i, f"http://s{'xyz'[rng.randrange(3)]}.com/{rng.choice(['fr', 'de'])}/" + "/".join(["one", "two"] * rng.randrange(2) + rng.sample(words, rng.randrange(5)))) for i in range(120)]
    rows += [(1000 + i, f"http://s{'xyz'[rng.randrange(3)]}.net/q/" + "/".join(rng.sample(["one", "two", "fr", *words], rng.randrange(6)))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(5)
    for m in (url_rules.Mining(0.05, 0.6), url_rules.Mining(0.1, 0.5), url_rules.Mining(0.05, 0.6, max_broadcast_rules=0)):
        want = mined_by_hand(tokens_and_labels(pages), m)
        got = {r["page_id"]: (r["verdict"], r["mined_confidence"]) for r in url_rules.judge(pages, mining=m).collect()}
        assert {i: got[i] for i in want} == want and len({v for v in want.values()}) > 3


def test_many_common_tokens(spark):
    """25 path words that all URLs of a site share, under one label and under both: 2^25 subsets if each were mined."""
    common = "/".join(f"part{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(25))
    rows = [(i, f"http://site.com/{'de' if i % 3 else 'fr'}/{common}/{'x' if i % 2 else 'y'}") for i in range(60)] + [(60 + i, f"http://own.com/de/{common.upper()}Q") for i in range(9)]
    rows += [(100, f"http://other.net/{common}/x"), (101, "http://other.net/partc")]
    start = time.monotonic()
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"), mining=url_rules.Mining(min_confidence=0.6)).collect()}
    assert got[100] == got[101] == "block" and len(got) == len(rows) and time.monotonic() - start < 60


def test_pipeline(spark, docs, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    columns, now = docs.columns, docs
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"] for r in now.select("doc_id").collect()}
        now = stage(spark, now, sf_dir).persist()
        assert {r["doc_id"] for r in now.select("doc_id").collect()} <= before
        assert now.columns == columns if name != "mixing" else set(columns) < set(now.columns)
    whole = pipeline.run(spark, sf_dir)
    assert sorted((r["doc_id"], r["taken"]) for r in whole.collect()) == sorted((r["doc_id"], r["taken"]) for r in now.collect())
