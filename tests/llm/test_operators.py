"""The operators on Spark: odd rows, empty tables, extra columns, and brute force on small tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import bpe, chat, decontam, html_extract, license_scan, lsh_forest, pii, quality_rules, url_filter, weak_label
from orrery.llm.common import table
from orrery.llm.queries import ORACLES, QUERIES
from tests.oracle import SF, connect, rows_of, rows_of_sql

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, a string, comp bigint, kept string"
LONG = "alpha beta gamma delta " * 5000


def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 1, "x", 2, "y") for i, t in rows], DOCS)


def odd(spark):
    return docs(spark, [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "one two three"), (5, "one two three"), (6, "one two three"), (None, "one two three")])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def by_id(df, key="doc_id"):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


# --- each operator on odd rows and on none ---


def test_pii_rows(spark):
    got = by_id(pii.scan(odd(spark)))
    assert len(got) == 7 and len(got[5]) == 2
    assert got[1][0]["spans"] == "" and got[1][0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.scan(docs(spark, [])).count() == 0
    red = by_id(pii.redact(docs(spark, [(1, "to a.b@c.de"), (2, None)])))
    assert red[1][0]["text"] == "to [EMAIL]" and red[1][0]["n_chars"] == 10 and red[1][0]["kept"] == "y" and red[2][0]["text"] is None


def brute_statistics(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = collections.defaultdict(list)
    for i in range(len(ws) - 2):
        windows[tuple(ws[i : i + 3])].append(i)
    covered = {i + k for p in windows.values() if len(p) > 1 for i in p for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    r = random.Random(1)
    made = [(i, "".join(r.choices(["a", "b", "c", " ", "\n", "\t", "#", "|", "é", "\x0b", "\U0001f600"], k=r.randint(0, 60)))) for i in range(300)]
    made += [(1000, None), (1001, "x y z " * 400), (1002, LONG)]
    got = by_id(quality_rules.statistics(docs(spark, made)))
    for i, t in made:
        x = got[i][0]
        assert tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_statistics(t or ""), (i, t)


def test_quality_rules_rows(spark):
    d = table(spark, SF, "documents")
    rules = quality_rules.fit(d, table(spark, SF, "labels"))
    got = by_id(quality_rules.judge(odd(spark), rules))
    assert len(got[5]) == 2 and all(x["base_failed"] and not x["kept"] for x in got[1] + got[2] + got[4] + got[5])
    assert quality_rules.judge(docs(spark, []), rules).count() == 0
    for empty in (quality_rules.fit(d, labels(spark, [])), quality_rules.fit(docs(spark, []), labels(spark, [(1, 0, 0)]))):
        assert list(empty) == [] and empty.default
    # the list as Spark runs it, against a plain reading of it
    rows = quality_rules.judge(d, rules).join(quality_rules.statistics(d).select("doc_id", *quality_rules.FEATURES[1:]), "doc_id").collect()
    for x in rows:
        first = next((i for i, rule in enumerate(rules) if rule.holds(x.asDict())), None)
        assert x["rule"] == first and x["kept"] == (not x["base_failed"] and (rules[first].keep if first is not None else rules.default))
    judged = quality_rules.judge(d, rules).join(table(spark, SF, "labels"), "doc_id").where("not base_failed")
    assert judged.where("quality = 1 and not kept").count() == 0
    assert all(isinstance(r, quality_rules.Rule) for r in rules)


def test_decontamination(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    items = [[word() for _ in range(r.randint(14, 40))] for _ in range(30)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, " ".join(items[0])), (98, "too short"), (97, None)], "item_id bigint, text string")
    rows, want = [], set()
    for i in range(120):
        own = [word() for _ in range(r.randint(0, 60))]
        j = r.randrange(30)
        w = list(items[j])
        if i % 4 == 0:  # whole
            want.add((i, j))
        elif i % 4 == 1:  # every ninth word another
            w = [word() if k % 9 == 4 else x for k, x in enumerate(w)]
            want.add((i, j))
        elif i % 4 == 2:  # the middle
            w = w[1:-1]
            want.add((i, j))
        else:  # too few
            w = w[:6]
        at = r.randint(0, len(own))
        rows.append((i, r.choice([" ", "\n", ", "]).join(own[:at] + [x.upper() if i % 3 == 0 else x for x in w] + own[at:])))
    d = docs(spark, [*rows, (200, None), (201, ""), (202, LONG)])
    got = decontam.overlaps(d, bench)
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want
    assert decontam.overlaps(d, bench.limit(0)).count() == 0 and decontam.overlaps(docs(spark, []), bench).count() == 0
    left = decontam.remove(d.union(docs(spark, [(None, "x")])), bench)
    assert left.columns == d.columns and left.count() == 124 - len({i for i, _ in want})
    old, decontam.BLOCK_WINDOWS = decontam.BLOCK_WINDOWS, 500
    try:
        assert {(x["doc_id"], x["item_id"]) for x in decontam.overlaps(d, bench).collect()} == want  # in several passes
    finally:
        decontam.BLOCK_WINDOWS = old


def test_decontamination_of_short_overlaps_at_every_place(spark):
    item = [f"item{i}" for i in range(15)]
    met = lambda e: any(all(e[i + k] for k, c in enumerate(m) if c == "1") for m in decontam.MASKS for i in range(len(e) - 8))
    gain = lambda e: sum(1 if x else -decontam.SUBSTITUTION_COST for x in e)

    def reported(e):
        best = max(((a, b) for a in range(len(e)) for b in range(a + 1, len(e) + 1)), key=lambda x: (gain(e[x[0] : x[1]]), -x[1], x[0]))
        return met(e) and sum(e[slice(*best)]) >= decontam.MIN_WORDS

    rows, want, changed = [], set(), 0
    for n in range(10, 16):
        for subs in {(), *((a,) for a in range(1, n - 1)), *((a, b) for a in range(1, n - 1) for b in range(a + 1, n - 1))}:
            for before in range(3):
                if reported([k not in subs for k in range(n)]):
                    want.add(len(rows))
                    changed += len(subs) > 0
                rows.append((len(rows), " ".join([f"own{k}" for k in range(before)] + [f"new{k}" if k in subs else item[k] for k in range(n)] + ["own"] * 9)))
    assert changed > 300
    got = decontam.overlaps(docs(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert {x["doc_id"] for x in got.collect()} == want


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (3, None, None, "who"), (None, 1, "x", "y"), (4, 1, "a", "t"), (4, 1, "a", "t")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn int, role string, text string, part int, speaker int")
    got = {(x["conv_id"], x["speaker"]): x for x in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (3, "unknown"), (None, "x"), (4, "a")}
    ann = got[1, "ann"]
    assert ann["text"] == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi <\\|end|><|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\nbye<|end|>\n"
    assert [ann["text"][a:b] for a, b in ann["mask"]] == ["hi <\\|end|><|end|>\n", "bye<|end|>\n"]
    assert [got[1, "bob"]["text"][a:b] for a, b in got[1, "bob"]["mask"]] == ["<|end|>\n"]
    assert got[4, "a"]["n_turns"] == 2 and len(got[4, "a"]["mask"]) == 2
    assert chat.rotate(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, i, "ab"[i % 2], str(i)) for i in range(300)], "conv_id bigint, turn int, role string, text string")
    views = chat.rotate(long)
    parts = views.where("speaker = 'a'").orderBy("part").collect()
    want = "".join(f"<|{'assistant' if i % 2 == 0 else 'user name=b'}|>\n{i}<|end|>\n" for i in range(300))
    assert len(parts) == 3 and "".join(p["text"] for p in parts) == want
    one = chat.whole(views).where("speaker = 'a'").first()
    assert one["text"] == want and one["n_turns"] == 300 and [want[a:b] for a, b in one["mask"]] == [f"{i}<|end|>\n" for i in range(0, 300, 2)]


def test_chat_of_odd_turn_numbers_and_names(spark):
    rows = [(1, None, "a|>\nb", f"t{i:03}") for i in range(300)] + [(1, 5, "back\\<|", f"u{i:03}") for i in range(290)] + [(1, i, "c", f"w{i}") for i in range(100)] + [(None, None, None, None)] * 300
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    views = chat.rotate(df)
    assert views.agg(F.max("n_turns")).first()[0] < 2 * chat.PART_TURNS
    got = {(r["conv_id"], r["speaker"]): r for r in chat.whole(views).collect()}
    assert set(got) == {(1, "a|>\nb"), (1, "back\\<|"), (1, "c"), (None, "unknown")}
    c = got[1, "c"]
    assert c["n_turns"] == 690 and [c["text"][a:b] for a, b in c["mask"]] == [f"w{i}<|end|>\n" for i in range(100)]
    assert c["text"].count("<|user name=a|\\>\\nb|>\n") == 300 and c["text"].count("<|user name=back\\\\<\\||>\n") == 290
    assert sorted(re.findall(r"[tuw]\d+(?=<)", c["text"])) == sorted(t for i, _, _, t in rows if i == 1)
    assert [x for x in re.findall(r"w(\d+)<", c["text"])] == [str(i) for i in range(100)] and c["text"].index("t000") < c["text"].index("w0<") < c["text"].index("u000") < c["text"].index("w6<")


def test_classifier(spark):
    d, known = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = weak_label.fit(d, known)
    got = weak_label.score(d, model).select("doc_id", "kept").join(known, "doc_id")
    right = got.where("(quality = 1 and toxic = 0) = kept").count()
    assert right >= 0.8 * got.count() and got.where("quality = 1 and toxic = 0 and not kept").count() <= 0.05 * got.count()
    rows = by_id(weak_label.score(odd(spark), model))
    assert len(rows) == 7 and rows[5][0] == rows[5][1]
    left = weak_label.keep(odd(spark), model)
    assert left.columns == odd(spark).columns
    assert weak_label.score(docs(spark, []), model).count() == 0
    for empty in (weak_label.fit(docs(spark, []), labels(spark, [])), weak_label.fit(d, None)):
        assert weak_label.score(d, empty).count() == d.count()


def test_classifier_on_labels_held_out_of_it(spark):
    folder = SF.replace("0.001", "0.01")
    d, known = table(spark, folder, "documents"), table(spark, folder, "labels")
    kept_out = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    model = weak_label.fit(d, known.join(kept_out, "doc_id", "left_anti"))
    got = weak_label.score(d, model).select("doc_id", "kept").join(kept_out, "doc_id").select("kept", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).collect()
    assert len(got) > 20 and sum(x["kept"] == x["good"] for x in got) >= 0.9 * len(got)
    alone = weak_label.fit(d, None)  # by the heuristics alone
    got = weak_label.score(d, alone).select("doc_id", "kept").join(known, "doc_id").select("kept", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).collect()
    assert sum(x["kept"] == x["good"] for x in got) >= 0.8 * len(got)


def test_licenses(spark):
    got = by_id(license_scan.scan(docs(spark, [(1, None), (2, "Licensed under the Apach License, version 2.0!"), (3, "all  rights\nreserved"), (3, "x"), (4, LONG)])))
    assert got[1][0]["labels"] == "" and got[2][0]["labels"] == "apache-2.0" and 0.9 < got[2][0]["score"] < 1 and got[2][0]["base_labels"] == ""
    assert sorted(x["labels"] for x in got[3]) == ["", "reserved"] and got[4][0]["n_words"] == 20000
    assert license_scan.scan(docs(spark, [])).count() == 0


def brute_components(rows, k):
    sets = {}
    for i, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(ws[x : x + k]) for x in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if i < j and a and b and comp[i] != comp[j] and 100 * len(a & b) >= 80 * len(a | b):
                    lo, hi = sorted((comp[i], comp[j]))
                    comp = {x: lo if c == hi else c for x, c in comp.items()}
                    changed = True
    return {i: len(s) for i, s in sets.items()}, comp


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    r = random.Random(k)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    rows = []
    for g in range(12):
        base = [word() for _ in range(r.choice([3, 30, 120, 300]))]
        for _ in range(r.choice([1, 2, 5, 25])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows) * 3, r.choice([" ", "  ", "\n"]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
    rows += [(1001, None), (1002, ""), (1003, "one"), (1004, "ONE"), (1005, LONG), (1006, LONG + "end")]
    sizes, comp = brute_components(rows, k)
    got = by_id(lsh_forest.near_duplicates(docs(spark, rows).repartition(5), k))
    assert {i: x[0]["n_shingles"] for i, x in got.items()} == sizes
    assert {i: x[0]["component_id"] for i, x in got.items()} == comp
    assert all(x[0]["kept"] == (comp[i] == i) for i, x in got.items())


def test_near_duplicates_of_odd_rows(spark):
    got = by_id(lsh_forest.near_duplicates(odd(spark), 4))
    assert len(got[5]) == 2 and got[6][0]["component_id"] == 5 and not got[6][0]["kept"]
    assert got[None][0]["component_id"] is None and got[None][0]["kept"]
    assert got[1][0]["component_id"] == 1 and got[2][0]["kept"] and got[1][0]["n_shingles"] == 0
    assert lsh_forest.near_duplicates(docs(spark, []), 4).count() == 0
    left = lsh_forest.deduplicate(odd(spark), 5)
    assert left.columns == odd(spark).columns and left.where("doc_id = 6").isEmpty()


def test_an_id_with_several_texts_links_what_its_texts_link(spark):
    a, b = ([f"{x}{i}" for i in range(40)] for x in "ab")
    rows = [(7, " ".join(a)), (9, " ".join([*a, "more"])), (7, " ".join(b)), (8, " ".join(b)), (11, " ".join([*b, "more"])), (5, "something else"), (5, None)]
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in lsh_forest.near_duplicates(docs(spark, rows), 4).collect()}
    assert got == {(7, 37): (7, True), (9, 38): (7, False), (8, 37): (7, False), (11, 38): (7, False), (5, 1): (5, True), (5, 0): (5, True)}
    left = lsh_forest.deduplicate(docs(spark, rows).withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id").cast("string"))), 4)
    assert sorted(r["doc_id"] for r in left.collect()) == ["id11", "id5", "id5"]


@pytest.mark.parametrize("crowd, block, shingles", [(4096, 2048, 1 << 20), (10, 16, 1 << 20), (10, 2048, 2000), (40, 7, 1 << 20)])
def test_crowded_regions_lose_no_link(spark, monkeypatch, crowd, block, shingles):
    """A chain of texts in which only neighbours are linked, beside many that resemble them without being linked; with depths and blocks of all kinds."""
    for name, value in (("CROWD", crowd), ("BLOCK", block), ("BLOCK_SHINGLES", shingles)):
        monkeypatch.setattr(lsh_forest, name, value)
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    base = [word() for _ in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([2, 6, 9, 12])):
            w[r.randrange(200)] = word()
        rows.append((i, " ".join(w)))
    sizes, comp = brute_components(rows, 4)
    got = by_id(lsh_forest.near_duplicates(docs(spark, rows), 4))
    assert {i: x[0]["component_id"] for i, x in got.items()} == comp
    assert 1 < len(set(comp.values())) < 150


def test_pages(spark):
    boiler = "all of our offers are on this page every day"
    rows = [(i, f"https://h.org/{i}", f"<body><div>{boiler} now</div><div>own words number {i} stand here and nowhere else at all</div></body>") for i in range(6)]
    rows += [(10, "https://h.org/a", f"<article><p>{boiler}</p></article><footer>{boiler}</footer>"), (11, None, None), (12, "https://other.org", f"<p>{boiler}</p>"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, open int")
    got = by_id(html_extract.extract(df), "page_id")
    assert len(got[0]) == 2 and got[3][0]["text"] == "own words number 3 stand here and nowhere else at all"
    assert got[10][0]["text"] == boiler and got[12][0]["text"] == boiler and got[11][0]["text"] == "" and got[11][0]["n_chars"] == 0
    assert html_extract.extract(df.limit(0)).count() == 0


def test_repeated_substrings_are_removed_like_brute_force(spark, monkeypatch):
    """Doubtful blocks, with and without article, against a plain search for substrings that distinct frames share."""
    monkeypatch.setattr(html_extract, "GROUP_PAGES", 7)  # several groups a host
    r = random.Random(21)
    phrases = [[f"p{k}w{i}" for i in range(r.randint(5, 14))] for k in range(6)]
    rows, parts = [], {}
    for i in range(60):
        body, mine = [], []
        for b in range(r.randint(1, 4)):
            words = [f"own{i}x{b}y{k}" for k in range(r.randint(0, 5))]
            for _ in range(r.randint(0, 2)):
                words += r.choice(phrases) + [f"own{i}x{b}z{r.random()}" for _ in range(r.randint(0, 2))]
            if words:
                sure = i % 3 == 0 and r.random() < 0.5
                mine.append((sure, words))
                body.append(f"<p{'' if sure or i % 3 else ' class=notice-text'}>{' '.join(words)}</p>")
        html = "".join(body)
        host = f"h{i % 4 // 3}.org"
        rows.append((i, f"http://{host}/{i}", f"<article>{html}</article>" if i % 3 == 0 else html))
        parts[i] = (host, mine)
    frames = collections.defaultdict(set)
    for host, mine in parts.values():
        frames[host].add(tuple(tuple(w) for sure, w in mine if not sure))
    n = html_extract.RUN
    for i, (host, mine) in parts.items():
        kept = []
        for sure, w in mine:
            covered = set()
            for a in range(len(w) - n + 1 if not sure else 0):
                pages = sum(any(block[x : x + n] == tuple(w[a : a + n]) for block in frame for x in range(len(block) - n + 1)) for frame in frames[host])
                if pages >= html_extract.MIN_PAGES:
                    covered |= set(range(a, a + n))
            kept += [x for k, x in enumerate(w) if k not in covered]
        parts[i] = " ".join(kept)
    got = by_id(html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")), "page_id")
    assert {i: x[0]["text"] for i, x in got.items()} == parts
    assert sum(len(t.split()) for t in parts.values()) < sum(len(re.sub("<[^>]*>", " ", h).split()) for *_, h in rows)


@pytest.mark.parametrize("all_let_through", [False, True])
def test_articles_go_through_the_suffix_arrays_of_their_host(spark, monkeypatch, all_let_through):
    """Pages that markup alone could settle: the frames' shared runs are found in articles, whose text markup then keeps whole."""
    monkeypatch.setattr(html_extract, "GROUP_PAGES", 7)  # several groups a host
    if all_let_through:
        monkeypatch.setattr(html_extract, "run_filter", lambda shared: np.full(html_extract.FILTER_BITS // 8, 255, np.uint8))
    r = random.Random(22)
    phrases = [[f"p{k}w{i}" for i in range(r.randint(6, 14))] for k in range(8)]
    rows, pages = [], {}
    for i in range(60):
        frame, article = ([[f"own{i}x{b}y{k}" for k in range(r.randint(0, 3))] + r.choice(phrases) + r.choice(phrases) for b in range(r.randint(1, 3))] for _ in range(2))
        host = f"h{i % 15 // 7}.org"
        pages[i] = host, frame, article
        rows.append((i, f"http://{host}/{i}", "".join(f"<footer>{' '.join(b)}</footer>" for b in frame) + f"<article>{''.join(f'<p>{chr(32).join(b)}</p>' for b in article)}</article>"))
    n = html_extract.RUN
    runs = lambda block: [tuple(block[a : a + n]) for a in range(len(block) - n + 1)]
    frames = collections.defaultdict(set)
    for host, frame, _ in pages.values():
        frames[host].add(tuple(map(tuple, frame)))
    held = {host: collections.Counter(x for f in of for x in {x for block in f for x in runs(block)}) for host, of in frames.items()}
    want = {}
    for i, (host, _, article) in pages.items():
        covered = {(b, a + k) for b, block in enumerate(article) for a, x in enumerate(runs(block)) if held[host][x] >= html_extract.MIN_PAGES for k in range(n)}
        text = " ".join(w for block in article for w in block)
        want[i] = (text, len(text), 0, len(covered))
    got = by_id(html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")), "page_id")
    assert {i: (x[0]["text"], x[0]["n_chars"], x[0]["n_cut"], x[0]["n_repeated"]) for i, x in got.items()} == want
    assert 0 < sum(x[3] for x in want.values()) < sum(len(x[0].split()) for x in want.values())


def test_urls(spark):
    urls = {1: "http://WWW.Example.NET/en/x?y#z", 2: "https://a.example.net/", 3: "http://example.com/de/", 4: "http://example.com", 5: "http://x.org/fr/1", 6: "http://free-bets.example.com/x", 7: None, 8: "no scheme", 9: "http://badcasino.com/", 10: "http://notexample.net", 11: "x://y.net?q=/en/", 12: "http://e.com/a\nb"}
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in urls.items()], "page_id bigint, url string, host string, path string")
    got = {i: x[0] for i, x in by_id(url_filter.judge(df), "page_id").items()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.example.net", "/en/x", "example.net/en/", "allow")
    assert [got[i]["rule"] for i in range(2, 13)] == ["net/", "example.com/de/", None, "org/fr/", None, None, None, None, None, None, None]
    assert [got[i]["verdict"] for i in (2, 3, 4, 5, 6, 7, 8, 9)] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow"]
    assert (got[7]["host"], got[7]["path"], got[11]["host"], got[11]["path"]) == ("", "", "y.net", "")
    assert url_filter.judge(df.limit(0)).count() == 0
    old, url_filter.MAP_RULES = url_filter.MAP_RULES, 0
    try:
        assert rows_of(url_filter.judge(df)) == rows_of(url_filter.judge(df))
        assert {i: x[0]["verdict"] for i, x in by_id(url_filter.judge(df), "page_id").items()} == {i: x["verdict"] for i, x in got.items()}
    finally:
        url_filter.MAP_RULES = old


def test_urls_by_index_equal_all_expressions(spark, monkeypatch):
    r = random.Random(31)
    tokens = sorted({t for p in url_filter.PATTERNS for t in re.findall(r"[a-z0-9]+", p)})
    made = ["".join([r.choice(["http://", "https://www.", "HTTP://x."]), *(r.choice([*tokens, "aa", "com"]) + r.choice([".", "/", "-", "?", "=", "&", "_", "", "/", "."]) for _ in range(r.randint(1, 9)))]) for _ in range(1500)]
    made += ["https://a.ads.com/", "http://cdn.a.com/banner/x.gif", "http://a.com/out.php?x=1&url=b", "http://a.com/track/1/open.gif", "http://win9.casino.com/"]
    want = [any(re.search(url_filter.regex_of(p), u.lower()) for p in url_filter.PATTERNS) for u in made]
    assert 300 < sum(want) < 1200
    df = spark.createDataFrame(list(enumerate(made)), "page_id bigint, url string")
    for bound in (url_filter.MAP_RULES, 0):
        monkeypatch.setattr(url_filter, "MAP_RULES", bound)
        got = {x["page_id"]: x["verdict"] == "block" for x in url_filter.judge(df, site_rules=(("nowhere.invalid", "/", "allow"),)).collect()}
        assert [got[i] for i in range(len(made))] == want


def test_bpe_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    got = by_id(bpe.round_trip(odd(spark)))
    for i, t in ((1, ""), (3, " \n\t"), (4, LONG), (5, "one two three")):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i][0]["n_tokens"] == len(ids) and got[i][0]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[i][0]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert len(got[5]) == 2 and bpe.round_trip(docs(spark, [])).count() == 0
    assert by_id(bpe.encode(odd(spark)))[5][0]["decoded"] == "one two three"


# --- queries and pipeline ---


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(connect(), ORACLES[name])


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "pii", "bpe"]
    d = table(spark, SF, "documents")
    known = by_id(table(spark, SF, "labels"))
    for name, stage in p.STAGES:
        before, d = d, stage(spark, d, SF)
        if name != "bpe":
            assert d.columns == before.columns
            d = d.persist()
            assert 0 < d.count() <= before.count()
    ids = {r["doc_id"] for r in before.collect()}
    out = d.collect()
    assert {r["doc_id"] for r in out} == ids and all(r["ids"] or not r["decoded"] for r in out)
    clean = {i for i, x in known.items() if x[0]["quality"] == 1 and x[0]["toxic"] == 0}
    assert not {i for i, x in known.items() if x[0]["quality"] == 0 or x[0]["toxic"] == 1} & ids or len(ids & clean) > 0.8 * len(ids & set(known))
    assert not any(re.search(r"[a-z0-9]@[a-z0-9-]+\.", r["decoded"]) for r in out)


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as p

    base = table(spark, SF, "documents")
    d = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, LONG, None, "s", len(LONG))], base.schema)
    for rows in (d, d.limit(0)):
        for _, stage in p.STAGES:
            rows = stage(spark, rows, SF)
        rows.collect()


def test_filter_by_ids(spark):
    from orrery.llm import common

    df = spark.createDataFrame([(i, str(i)) for i in range(-50, 3000)] + [(None, "none"), (7, "again")], "doc_id bigint, x string")
    ids = spark.createDataFrame([(i,) for i in range(-50, 3000, 7)], "doc_id bigint")
    want = {i for i in range(-50, 3000, 7)}
    inside, outside = common.with_ids(df, ids, "doc_id"), common.without_ids(df, ids, "doc_id")
    assert inside.columns == outside.columns == ["doc_id", "x"]
    assert {r["doc_id"] for r in inside.collect()} == want and inside.count() + outside.count() == df.count()
    assert outside.where("doc_id is null").count() == 1 and not want & {r["doc_id"] for r in outside.collect()}
    assert common.with_ids(df, ids.limit(0), "doc_id").count() == 0 and common.without_ids(df, ids.limit(0), "doc_id").count() == df.count()


def test_scratch_folders_are_deleted(spark):
    from orrery.llm import common

    df = spark.range(10)
    with common.scratch(spark) as kept:
        kept.add("kept")
        a, b = common.materialise(df, "kept"), common.materialise(df, "other")
        gone = b.inputFiles()[0].removeprefix("file://")
    import os

    assert a.count() == 10 and not os.path.exists(gone)


def test_one_file_is_spread_over_all_cores(spark, tmp_path):
    from orrery.llm import common

    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert common.spread(one).select(F.spark_partition_id().alias("p")).distinct().count() == spark.sparkContext.defaultParallelism
    assert common.spread(spark.range(5)).count() == 5
