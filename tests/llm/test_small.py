"""Nulls, empty and long texts, ties, repeats, empty tables, extra columns; brute force where SQL can't say it."""

import random
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from claimloom.llm import p01_markup as p1
from claimloom.llm import p02_concepts as p2
from claimloom.llm import p03_lookalikes as p3
from claimloom.llm import p04_copies as p4
from claimloom.llm import p05_scans as p5
from claimloom.llm import p06_clusters as p6
from claimloom.llm import p07_components as p7
from claimloom.llm import p08_packing as p8
from claimloom.llm import p09_leaks as p9
from claimloom.llm import p10_quality as p10
from claimloom.llm.lookalike import Lattice, fold, skeleton
from claimloom.llm.mincut import min_cut
from claimloom.llm.spelling import Dictionary, distance


def docs(spark, texts, **extra):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


# --- problem 1 --------------------------------------------------------------


def test_min_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 7)
        costs = [(rng.randint(0, 5), rng.randint(0, 5)) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 4)) for _ in range(n * 2)]
        price = lambda x: sum(c[v] for c, v in zip(costs, x)) + sum(w for i, j, w in edges if x[i] != x[j])
        best = min(price([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert price([int(v) for v in min_cut(costs, edges)]) == best


@pytest.mark.parametrize(
    "text, found",
    [
        ("Plain text (p < .05) costs $5 and $7 [12].\n\n* item\n1. item\n> .10).", []),
        ("It is <em>so</em>.", ["html"]),
        ("A &amp; B", ["html"]),
        ("# Title\n\nText with **bold**.\n\n$$y = 2x$$", ["markdown"]),
        ("== Title ==\n\nA [[link]]<ref>n</ref>.\n\n# one\n# two\n\n<math>x=1</math>", ["wiki"]),
        ("\\section{T}\nWe see $\\beta_{x}$ in \\emph{it}.", ["latex"]),
        ("One \\emph{word} and a break. <br>", ["html", "latex"]),
        ("", []),
    ],
)
def test_markup(text, found):
    assert p1.languages(text) == found


def test_markup_clean(spark):
    assert p1.clean_text("<h1>T</h1>\n<p>A &lt; B</p><ul><li>one</li></ul>")[0] == "# T\n\nA < B\n\n- one"
    assert p1.clean_text("\\section{T}\n\\begin{itemize}\n\\item a\n\\end{itemize}\nIt is $x^2$.")[0].startswith("# T")
    got = p1.document_markup(docs(spark, [None, "", "x" * 200_000, "<b>x</b>", "<b>x</b>"], markups="clash")).orderBy("doc_id").collect()
    assert [r["markups"] for r in got] == [[], [], [], ["html"], ["html"]]
    assert p1.document_markup(docs(spark, []).where("false")).count() == 0


def test_markup_clean_rewrites_only_what_was_found():
    far = "The people said so. " * 250
    assert p1.clean_text(f"It is \\emph{{so}}. {far}\n% of all people agree.")[0].endswith("\n% of all people agree.")
    assert p1.clean_text("\\section{T}\n% todo\nIt is \\emph{so}.")[0] == "# T\n\nIt is so."
    equation = "\\section{T}\nWe see\n\\begin{equation}\n\\label{e}\ny = \\frac{1}{2} x_i\n\\end{equation}\nhere."
    assert p1.clean_text(equation)[0] == "# T\n\nWe see\n$y = \\frac{1}{2} x_i$\nhere."
    assert p1.clean_text("\\section{T}\n\\begin{verbatim}\nf \\emph{x} % no\n  g\n\\end{verbatim}\nend")[0] == "# T\n\n    f \\emph{x} % no\n      g\n\nend"
    for formula in ("$2\\alpha + 1$", "$" + "\\beta + " * 40 + "1$", "$\\alpha\n+ \\gamma$"):
        assert p1.clean_text(f"\\section{{T}}\nIt is \\emph{{so}}: {formula}, about \\$5.")[0] == f"# T\n\nIt is so: {formula}, about $5."
    assert p1.clean_text("== T ==\nA [[x|y]]<ref>n</ref> <nowiki>[[z]]</nowiki> {{t}}.\n* one\n# two")[0] == "# T\nA y [[z]] .\n- one\n- two"
    assert p1.clean_text("# T\n\n```py\n**a** \n```\nIs **b** and [c](http://d.e/f).\n\n$$y = 2x$$")[0] == "# T\n\n    **a**\n\nIs b and c.\n\n$y = 2x$"
    assert p1.clean_text("<pre>a &lt; <b>\nb</pre><p>x</p><table><tr><td>1</td><td>2</td></tr></table>")[0] == "    a < <b>\n    b\n\nx\n\n1 | 2"
    assert p1.clean_text("")[0] == "" and p1.clean_text("5 < 7 % no\n% line")[0] == "5 < 7 % no\n% line"


def test_constructs_of_any_length():
    long = "word " * 200
    for text, found in ((f'<a title="{long}">x</a>', ["html"]), (f"[[{long}|y]]", ["wiki"]), (f"{{{{box|a={long}\n|{long}}}}}", ["wiki"]), (f"It is **{long.strip()}**.", ["markdown"]), (f"[{long}](http://x.y/{'z' * 900})", ["markdown"]), (f"$\\alpha + {long}$", ["latex"])):
        assert p1.languages(text) == found
        assert not p1.languages(p1.clean_text(text)[0]) or found == ["latex"]
    deep = "<ul>" * 30 + "<li>x" + "</ul>" * 30
    assert len(p1._elements(p1.find_marks(deep), deep)) == 30


def test_links_and_templates():
    assert p1.clean_text("A [[Topic:word|label]] and {{lang|fr|mot}}{{cite book|x}} of {{nowrap|two words}}.")[0] == "A label and mot of two words."


def test_boilerplate_is_cut_from_content():
    prose = "The people of the town said that it was not the first time that the river had been so high."
    page = f"<html><nav><a href='/'>Home</a>\n<a href='/s'>Search the site</a></nav><h1>Log in</h1><p>{prose}</p><p>Short one</p><ul><li>Menu</li></ul><footer>Imprint of the site</footer><button>Subscribe</button></html>"
    clean = p1.clean_text(page)[0]
    assert clean == f"# Log in\n\n{prose}\n\nShort one\n\n- Menu"
    # fitted odds: what is learned from blocks of known class goes to those of none
    odds = p1.fit_blocks([page] * 50)
    assert odds["words:10"] < 0 < odds["control"] and odds["ends"] < odds["open"] and p1.clean_text(page, odds)[0] == clean


# --- problem 2 --------------------------------------------------------------


def test_concepts(spark):
    c = spark.createDataFrame([("c1", "SHIFT FATIGUE", ["rota fatigue", "tiredness of rota"]), ("c2", "MEAL TRUST", None), ("c3", "UNION DRIVE", [])], "id string, leaf string, alt array<string>")
    cases = {"shift fatigue": "c1", "perceived Shift-Fatigue (wave 2)": "c1", "fatigue due to rota": "c1", "shiftfatigue among actors": "c1", "shfit fatigeu": "c1", "ti ##redness of rota [SEP]": "c1", "shift trust": "", "shift": "", "meal_trust": "c2", "private lending": "", "[CLS]": "", "union drive": "c3"}
    rows = [(i, s, None) for i, s in enumerate(cases)] + [(100, "-", ""), (101, None, "meal trust")]
    r = spark.createDataFrame(rows, "row_id long, cause string, effect string").withColumn("concept_id", F.lit("clash"))
    got = {(x["row_id"], x["side"]): x["concept_id"] for x in p2.map_spans(r, c).collect()}
    assert got == {(i, "cause"): v for i, v in enumerate(cases.values())} | {(101, "effect"): "c2"}
    assert p2.map_spans(r, c.where("false")).where("concept_id <> ''").count() == 0
    assert p2.map_spans(r.where("false"), c).count() == 0


def test_hot_spans_and_the_bound_of_the_dictionary(spark, monkeypatch):
    c = spark.createDataFrame([("c1", "SHIFT FATIGUE", [])], "id string, leaf string, alt array<string>")
    r = spark.createDataFrame([(i, "shift fatigue" if i % 3 else f"span {i % 40}", None) for i in range(4500)], "row_id long, cause string, effect string")
    got = p2.map_spans(r, c)
    assert got.count() == 4500 and got.where("concept_id = 'c1'").count() == 3000 == got.where("concept_id = 'c1' and row_id % 3 <> 0").count()
    assert "Broadcast" in got._jdf.queryExecution().toString()
    monkeypatch.setattr(p2, "MOST_ENTRIES", 10)
    with pytest.raises(ValueError):
        p2.map_spans(r, c)


def test_concept_in_a_long_span(spark):
    c = spark.createDataFrame([("c1", "SHIFT FATIGUE", [])], "id string, leaf string, alt array<string>")
    r = spark.createDataFrame([(1, "the " * 60 + "shift fatigue", "")], "row_id long, cause string, effect string")
    assert [x["concept_id"] for x in p2.map_spans(r, c).collect()] == ["c1"]


def _full_distance(a, b):
    """The same distance by recursion over all alignments."""
    from functools import cache

    @cache
    def d(i, j):
        if not i or not j:
            return float(i + j)
        x, y = a[i - 1], b[j - 1]
        c = [d(i - 1, j - 1) + (0 if x == y else 0.8 if x in "aeiouy" and y in "aeiouy" else 1), d(i - 1, j) + (0.7 if i > 1 and a[i - 2] == x else 1), d(i, j - 1) + (0.7 if j > 1 and b[j - 2] == y else 1)]
        if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
            c.append(d(i - 2, j - 2) + 0.8)
        return min(c)

    return d(len(a), len(b))


def test_distance_in_a_band():
    rng = random.Random(5)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abce") for _ in range(rng.randint(0, 9))) for _ in range(2))
        want = _full_distance(a, b)
        for most in (1.8, 2.0, 9.0):
            got = distance(a, b, most)
            assert abs(got - want) < 1e-9 if want <= most else got > most


def test_spelling():
    assert distance("abcd", "abdc") == 0.8 and distance("abc", "abc") == 0 and distance("a", "abcdef", 2) > 2
    d = Dictionary({"fatigue": 3, "trust": 1})
    assert d.lookup("fatgue")[0][2] == "fatigue" and d.lookup("zzz") == []


# --- problem 3 --------------------------------------------------------------


def test_lookalike_forms():
    m = Lattice({"co": 9, "op": 9, "pe": 9, "ca": 9, "at": 9})
    for a, b in (("cope", "соре"), ("Ａ cat", "A саt"), ("café", "café"), ("a b", "a b"), ("so­ft​", "soft"), ("well‑known", "well-known")):
        assert m.canonical(a + " wild") == m.canonical(b + " wild")
    assert m.canonical("a–b wild") != m.canonical("a-b wild") and fold("x²") == "x²"
    assert m.canonical("Привет мир") == "Привет мир" and skeleton("сredit") == "credit"


def test_lookalike_pairs(spark):
    t = spark.createDataFrame([("documents", 1, "the cat"), ("documents", 2, "the cаt"), ("documents", 3, "the cat"), ("documents", 4, "The cat"), ("sentences", 5, "the cаt"), ("documents", 6, None), ("documents", 7, "")], "tbl string, id long, text string")
    got = sorted(tuple(r) for r in p3.lookalike_pairs(p3.canonical_keys(t.where("text <> ''"))).collect())
    assert got == [("documents", 1, 2), ("documents", 2, 3)]
    assert p3.lookalike_pairs(p3.canonical_keys(t.where("false"))).count() == 0


def test_lookalikes_of_a_hot_string(spark, monkeypatch):
    monkeypatch.setattr(p3, "BLOCK", 7)
    rows = [("d", i, "the cat" if i % 3 else "the c\u0430t" if i % 2 else "the\u00a0cat") for i in range(90)] + [("d", 100, "the dog"), ("d", 101, "the dog")]
    keys = p3.canonical_keys(spark.createDataFrame(rows, "tbl string, id long, text string"))
    want = {("d", a, b) for a in range(90) for b in range(a + 1, 90) if rows[a][2] != rows[b][2]}
    assert {tuple(r) for r in p3.lookalike_pairs(keys).collect()} == want
    links = {i: sum(i in p[1:] for p in want) for i in range(90)}
    assert {r["id"]: (r["class_id"], r["n_links"]) for r in p3.lookalike_classes(keys).collect()} == {i: (0, n) for i, n in links.items()}


# --- problem 4 --------------------------------------------------------------


def test_payloads(spark):
    p = ['{"effect": "B", "doi": "1", "cause": "A"}', "doi=1|cause=A|effect=B", "cause=A;;effect=B;;doi=1", "effect=B, doi=1, cause=a; b | c", None, "{broken", ""]
    df = spark.createDataFrame([(x,) for x in p], "payload string")
    got = df.select(*(c.alias(n) for n, c in p4.parse_payload(F.col("payload")).items())).collect()
    assert [tuple(r) for r in got[:3]] == [("A", "B", "1")] * 3 and got[3]["cause"] == "a; b | c"
    assert [tuple(r) for r in got[4:]] == [("", "", "")] * 3


def test_copies_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(3000)}") for i in range(9000)] + [(10_000, None)]
    df = spark.createDataFrame(rows, "id long, key string").withColumn("n", F.lit(0))
    groups = defaultdict(list)
    for i, k in rows:
        if k:
            groups[k].append(i)
    got = {(r["keep_id"], r["copy_id"]) for r in p4.copies(df).collect()}
    assert got == {(min(v), i) for v in groups.values() for i in v if i != min(v)}
    assert {r["key"]: (r["keep_id"], r["n_copies"]) for r in p4.collapsed(df).collect()} == {k: (min(v), len(v)) for k, v in groups.items()}
    assert p4.copies(df.where("false")).count() == 0


# --- problem 5 --------------------------------------------------------------

PAGES = "\f".join(f"Annals of Quiet Things\nThe group was mea-\nsured again by us in the ho{x}se and the long\nline of text goes on as the people said.\n{n}" for n, x in ((11, "u"), (12, "ii"), (13, "u")))


def test_scan(spark):
    filler = "The house was measured again by us and the people said the long line of text goes on in the group as the house was. " * 40
    d = docs(spark, [PAGES, filler, None, "", "Just one line."], kinds="clash")
    lines = spark.createDataFrame([], "line_id long, doc_id string, page int, line_no long, text string")
    shared = p5._models(spark, d, lines.select("line_id", "doc_id", "page", "line_no", "text"))
    got = {r["doc_id"]: (r["kinds"], r["clean"]) for r in p5.document_noise(d, shared).collect()}
    assert got[0][0] == ["hyphen_break", "misread", "page_number", "running_head"]
    assert "measured again" in got[0][1] and "Annals" not in got[0][1] and "hoiise" not in got[0][1]
    assert [got[i][0] for i in (1, 2, 3, 4)] == [[], [], [], []] and got[2][1] == ""
    rows = [(10 * p + k, "d", p + 1, 10 * p + k, t) for p, page in enumerate(PAGES.split("\f")) for k, t in enumerate(page.split("\n"))] + [(99, None, None, None, None)]
    lines = spark.createDataFrame(rows, "line_id long, doc_id string, page int, line_no long, text string").withColumn("chunk", F.lit(1))
    found = {(r["line_id"], r["kind"]) for r in p5.line_noise(lines, shared).collect()}
    assert found == {(0, "running_head"), (10, "running_head"), (20, "running_head"), (4, "page_number"), (14, "page_number"), (24, "page_number"), (1, "hyphen_break"), (11, "hyphen_break"), (21, "hyphen_break"), (12, "misread")}


    text = {r["line_id"]: r["text"] for r in p5.line_paragraphs(lines, shared).collect()}
    assert text[1] == " ".join("The group was measured again by us in the house and the long line of text goes on as the people said." for _ in range(3))


def test_paragraph_over_chunks(spark, monkeypatch):
    """A paragraph longer than a chunk and its context keeps its first line."""
    monkeypatch.setattr(p5, "CHUNK", 20)
    monkeypatch.setattr(p5, "CONTEXT", 3)
    words = "the long line of text goes on and the people said it was so again".split()
    texts = [f"{' '.join(words)} {words[i % 9]}" for i in range(75)] + ["end."] + [f"Then {' '.join(words)}"] * 2
    lines = spark.createDataFrame([(100 + i, "d", 1, i, t) for i, t in enumerate(texts)], "line_id long, doc_id string, page int, line_no long, text string")
    d = docs(spark, texts)
    got = {r["line_id"]: r["text"] for r in p5.line_paragraphs(lines, p5._models(spark, d, lines)).collect()}
    assert got == {100: " ".join(texts[:76]), 176: " ".join(texts[76:])}


def test_line_model_learns_from_unreliable_labels():
    rng = random.Random(3)
    windows, truth = [], []
    for _ in range(120):
        page = [("head at an edge", "H")] + [("short", "T")] * 12 + [("number", "N")]
        page = page * 3
        said = [{"H": "running_head", "N": "page_number", "T": ""}[s] if rng.random() < 0.75 else rng.choice(["", "table_row", "heading", "page_number"]) for _, s in page]
        windows.append(([x for x, _ in page], said))
        truth.append("".join(s for _, s in page))
    m = p5.fit_lines(windows)
    assert [p5.viterbi(w, m) for w, _ in windows] == truth
    assert p5.fit_lines([]).look == p5._LOOK


def test_confusions_are_weighed():
    r = p5.Reader({"house": 100, "hers": 90, "form": 90, "corn": 100}, ["hoiise"] * 3)
    assert r.correct("hoiise") == "house" and max(r.weight, key=r.weight.get) == ("ii", "u") and abs(sum(r.weight.values()) - 1) < 1e-9


def test_every_rare_word_weighs_confusions(spark):
    """Far more rare words than a driver would want, 40 of which two confusions explain."""
    letters = "abdeghjk"
    frequent = [f"qu{a}{b}z" for a in letters for b in letters][:40]
    rare = [f"x{a}{b}{c}{d}{e}" for a in letters for b in letters for c in letters for d in letters for e in letters[:6]]
    texts = [" ".join(frequent * 40), *(" ".join(rare[i::20]) for i in range(20)), " ".join(w.replace("u", "ii") for w in frequent[:30]), " ".join(w.replace("z", "2") for w in frequent[30:])]
    lines = spark.createDataFrame([], "line_id long, doc_id string, page int, line_no long, text string")
    weight = p5._models(spark, docs(spark, texts), lines).value[0].weight
    total = 40 + len(p5.CONFUSIONS)
    assert len(rare) > 20_000 and abs(weight["ii", "u"] - 31 / total) < 1e-12 and abs(weight["2", "z"] - 11 / total) < 1e-12


def test_line_model_is_fitted_on_every_line(spark):
    rng = random.Random(9)
    rows, windows = [], []
    for d in range(1300):
        texts = [f"A {rng.choice(['Table', 'Note'])}"] * rng.randint(0, 2) + ["the people said the long line of text goes on"] * rng.randint(1, 40) + [str(d % 90)] * rng.randint(0, 1)
        said = [rng.choice([(True, ""), (False, "heading"), (False, "page_number"), (None, None), (False, "odd")]) for _ in texts]
        rows += [(len(rows) + i, f"d{d}", 1, i, t, *k) for i, (t, k) in enumerate(zip(texts, said, strict=True))]
        seen = p5._looks(texts, [1] * len(texts), frozenset(), [p5.head_key(t) for t in texts])
        windows.append((seen, ["unknown" if kept is None or why == "odd" else why for kept, why in said]))
    lines = spark.createDataFrame(rows, "line_id long, doc_id string, page int, line_no long, text string, kept boolean, drop_reason string")
    got, want = p5.line_model(lines, frozenset()), p5.fit_lines(windows)
    assert got.step == pytest.approx(want.step, abs=1e-6) and got.look.keys() == want.look.keys()
    assert all(got.look[x] == pytest.approx(want.look[x], abs=1e-6) for x in want.look)
    assert p5.line_model(lines.where("false"), frozenset()).look == p5._LOOK


def test_page_values():
    assert p5.page_value("[l6O]") == ("[#]", 160) and p5.page_value("xix") == ("roman#", 19) and p5.page_value("mild") is None
    assert p5.page_value("3 of 9") == ("#of", 3)


@pytest.mark.parametrize("end", [" \n", "\r\n", "\n"])
def test_cut_before_blanks(spark, end):
    filler = "The house was measured again by us and the people said the long line of text goes on in the group as the house was. " * 40
    text = f"The group was mea-{end}sured again by us in the house and the long{end}line of text goes on as the people said."
    d = docs(spark, [text, filler])
    lines = spark.createDataFrame([], "line_id long, doc_id string, page int, line_no long, text string")
    got = {r["doc_id"]: r["kinds"] for r in p5.document_noise(d, p5._models(spark, d, lines)).collect()}
    assert got == {0: ["hyphen_break"], 1: []}


# --- problem 6 --------------------------------------------------------------


def test_clusters(spark):
    words = [("private", "lending", "sculptor"), ("public", "lending", "sculptor"), ("mutual", "shyness", "cashier")]
    spans = []
    for a, b, c in words:
        spans += [f"{a} {b} among {c}s", f"the {a} {b} of {c}s", f"{b} that is {a}, in {c}s", f"{c}s' {a} {b}", f"degree of {a} {b} for {c}s"]
    spans += ["prviate lending of sculptors", None, "", "the"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], "span_id long, span string").withColumn("cluster", F.lit(7))
    got = defaultdict(set)
    for r in p6.clusters(df).collect():
        got[r["cluster"]].add(r["span_id"])
    assert sorted(map(sorted, got.values())) == [[0, 1, 2, 3, 4, 15], [5, 6, 7, 8, 9], [10, 11, 12, 13, 14]]
    assert p6.clusters(df.where("false")).count() == 0


def test_same_content():
    assert p6.jaccard("a b c", "a b d") == 0.5 and p6.jaccard("a shyness? b", "a shynes? b") == 1 and p6.jaccard("", "") == 0
    assert p6.same_content("a shyness? b", "a shynes? b") and not p6.same_content("a sailor b", "a tailor b") and not p6.same_content("a b", "a b c")


def _misspelt(rng, w):
    w = list(w)
    for _ in range(rng.randint(0, 2)):
        i = rng.randrange(len(w) - 1)
        kind = rng.randrange(4)
        if kind == 0:
            w[i], w[i + 1] = w[i + 1], w[i]
        elif kind == 1:
            del w[i]
        elif kind == 2:
            w.insert(i, rng.choice("aeimnrst"))
        else:
            w[i] = rng.choice("aeimnrst")
    return "".join(w)


def _links(spark, keys):
    """(links found, links by brute force) between records of these keys."""
    keys = sorted(set(keys))
    records = spark.createDataFrame([(i, k, 1 + i % 7, "?" in k) for i, k in enumerate(keys)], "rid long, key string, n long, odd boolean").withColumn("bucket", F.lit(0))
    got = {tuple(sorted([keys[r["a"]], keys[r["b"]]])) for r in p6.verified_links(records).collect()}
    return got, {tuple(sorted([a, b])) for i, a in enumerate(keys) for b in keys[:i] if p6.same_content(a, b)}


def test_links_against_brute_force(spark):
    rng = random.Random(8)
    words = ["solitude", "burnout", "rumination", "grief", "envyful", "hippopotomonstrosesquippedalio", "antidisestablishmentarianismists"]
    keys = ["solitude?", "solitdue?", "burnout?", "burnuot?", "rumination?", "rumniatoin?"]
    for _ in range(300):
        odd = [_misspelt(rng, w) + "?" for w in rng.sample(words, rng.choice([1, 1, 1, 2]))]
        keys.append(" ".join(sorted({*odd, *rng.sample(["coach", "meal", "union"], rng.randint(0, 1))})))
    got, want = _links(spark, keys)
    assert got == want and len(want) > 300


def test_links_of_large_buckets(spark):
    # all share one bucket, and many match others but not the most frequent
    word = "rumination"
    more = [word[:i] + c + word[i:] for i in range(11) for c in "aeoxz"]
    keys = [f"meal {w}?" for w in {*more, *(w[:j] + "y" + w[j:] for w in more[::4] for j in (0, 5, 9)), *(f"{word}{c}" for c in "bcdfg")}]
    # key lengths more than 2 apart, two edits in each of two words
    keys += ["meal rumin? solit?", "meal ruminan? solitan?", "coach hesitation? rumination?", "coach hesitationoo? ruminationoo?"]
    got, want = _links(spark, keys)
    assert len(keys) > 90 and got == want and len({a for a, _ in want}) > 64


def test_every_record_is_linked_to_its_cluster(spark):
    # written forms of one settled key are linked through the most frequent of them, settled words or not
    keys = ["coach grief", "coach grief", "coach grief", "grief", "coach rumniatoin?", "coach rumniatoin?", "coach rumination?"]
    records = spark.createDataFrame([(i, k, 10 - i) for i, k in enumerate(keys)], "rid long, key string, n long")
    assert {(r["a"], r["b"]) for r in p6.verified_links(records).collect()} == {(0, 1), (0, 2), (4, 5), (4, 6)}
    got = defaultdict(set)
    for r in p6.split_loose(records, p6.verified_links(records)).collect():
        got[r["cluster"]].add(r["rid"])
    assert dict(got) == {0: {0, 1, 2}, 3: {3}, 4: {4, 5, 6}}


def test_misspelt_plurals():
    s = p6.Speller({"coach": 50, "nurse": 50, "novice": 50, "midwife": 50, "cache": 50})
    for w, v in (("coahces", "coach"), ("nuress", "nurse"), ("novies", "novice"), ("midwives", "midwife"), ("caches", "cache"), ("coaches", "coach")):
        assert s.settle(w) == v


def test_pieces_find_what_deletions_find():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcd") for _ in range(n)) for n in range(12, 34) for _ in range(3)]
    d = Dictionary({w: 1.0 for w in words})
    for w in words:
        for _ in range(6):
            bad = _misspelt(rng, w)
            if 0 < distance(bad, w) <= 2:
                assert w in [x[2] for x in d.lookup(bad)]


def test_planted_spellings_are_recalled(spark):
    """Every link of a planted table: a third of all spans say one thing, each word of them may be misspelt."""
    rng = random.Random(12)
    sides, things, people = "private public mutual formal spatial".split(), "lending shyness hostility gratitude rumination".split(), "sculptors cashiers coaches nurses librarians".split()
    frames = ["{a} {b} among {c}", "the {a} {b} of {c}", "{b} that is {a}, in {c}", "{c} with {a} {b}"]
    spans, truth = [], []
    for i in range(1500):
        key = (sides[0], things[0], people[0]) if i % 3 == 0 else (rng.choice(sides), rng.choice(things), rng.choice(people))
        a, b, c = key
        if rng.random() < 0.1:
            k = rng.randrange(1, len(b) - 2)
            b = b[:k] + b[k + 1] + b[k] + b[k + 2 :]
        spans.append(rng.choice(frames).format(a=a, b=b, c=c))
        truth.append(key)
    got = defaultdict(set)
    for r in p6.clusters(spark.createDataFrame(list(enumerate(spans)), "span_id long, span string")).collect():
        got[r["cluster"]].add(r["span_id"])
    want = defaultdict(set)
    for i, key in enumerate(truth):
        want[key].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(1500)], "g long, i long")
    pairs = {(r[0], r[1]) for r in p6.pairs_within(rows, "g", "i").collect()}
    hot = [i for i in range(1500) if i % 3 or i == 0]
    assert pairs == {(a, b) for k, a in enumerate(hot) for b in hot[k + 1 :]}


def test_long_chain_is_split_to_its_end(spark, monkeypatch):
    def components(links, a, b):
        root = {}
        for x, y in sorted((min(r[a], r[b]), max(r[a], r[b])) for r in links.collect()):
            root[y] = root.setdefault(x, x)
        return spark.createDataFrame(sorted(root.items()), "v long, group_id long")

    monkeypatch.setattr(p6, "hash_to_min", components)
    # each spelling matches the next one; the first of the chain left over is the medoid of each round
    n = 48
    records = spark.createDataFrame([(i, "abcdefghijkl" + "xy" * i + "?", 1000 - i, True) for i in range(n)], "rid long, key string, n long, odd boolean")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    got = {r["rid"]: r["cluster"] for r in p6.split_loose(records, links).collect()}
    want, deg, left = {}, [1] + [2] * (n - 2) + [1], set(range(n))
    while left:
        of = {}
        for i in sorted(left):
            of[i] = of[i - 1] if i - 1 in of else i
        for c in {*of.values()}:
            members = [i for i in of if of[i] == c]
            m = max(members, key=lambda i: (deg[i], -i)) if len(members) > 1 else c
            for i in members:
                if abs(i - m) <= 1:
                    want[i] = m
                    left.discard(i)
    assert got == want and len({*want.values()}) > 20


# --- problem 7 --------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (200, 200), (None, 3), (3, None), (101, 100)]
    root = {v: v for p in pairs if None not in p for v in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("v", F.lit(0))
    assert {r["v"]: r["group_id"] for r in p7.hash_to_min(df).collect()} == {v: find(v) for v in root}
    assert p7.hash_to_min(df.where("false")).count() == 0


def test_components_with_a_hot_vertex(spark, monkeypatch):
    from claimloom.llm import hot

    monkeypatch.setattr(hot, "HOT_LEAST", 20)
    pairs = [(5, i) for i in range(6, 200)] + [(300, 301), (301, 302)]
    got = {r["v"]: r["group_id"] for r in p7.hash_to_min(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 5 for i in range(5, 200)}, 300: 300, 301: 300, 302: 300}


# --- problem 8 --------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 5, 33, 64, 100, 128, 250]) for _ in range(800)] + [None]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long").withColumn("at", F.lit(1))
    rows = p8.pack(df, 100).collect()
    held, placed = defaultdict(list), defaultdict(int)
    for r in rows:
        held[r["container"]].append((r["at"], r["n_tokens"]))
        placed[r["doc_id"]] += r["n_tokens"]
        assert r["n_tokens"] == 100 or r["first_token"] + r["n_tokens"] == sizes[r["doc_id"]]
        assert r["first_token"] == 0 or sizes[r["doc_id"]] > 100
    assert placed == {i: n for i, n in enumerate(sizes) if n}
    for items in held.values():
        at = 0
        for start, n in sorted(items):
            assert start == at
            at += n
        assert at <= 100
    assert len(held) <= 1.03 * -(-sum(filter(None, sizes)) // 100) + 1
    assert p8.pack(df.where("false"), 100).count() == 0


def test_patterns_use_every_item():
    rng = random.Random(9)
    for _ in range(30):
        h = {n: rng.randint(1, 9) for n in rng.sample(range(1, 65), 20)}
        used = defaultdict(int)
        for lengths, times in p8.plan_patterns(h, 64):
            assert sum(lengths) <= 64 and times > 0
            for n in lengths:
                used[n] += times
        assert used == h


# --- problem 9 --------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 8, 20, 90])))) for i in range(25)] + [(90, None), (91, "")]
    texts = []
    for _ in range(120):
        body = [rng.choice(vocab) for _ in range(60)]
        w = rng.choice(items[:25])[1].split()
        k = rng.randint(1, len(w))
        at = rng.randint(0, len(w) - k)
        texts.append(" ".join(body[:30] + [x.upper() + "," for x in w[at : at + k]] + body[30:]))
    want = set()
    for d, t in enumerate(texts):
        tw = p9.words(t)
        for i, s in items[:25]:
            w = s.split()
            need = -(-len(w) // 2)
            runs = {tuple(w[j : j + need]) for j in range(len(w) - need + 1)}
            if any(tuple(tw[j : j + need]) in runs for j in range(len(tw) - need + 1)):
                want.add((d, i))
    df, it = docs(spark, texts + [None, ""], item_id=1), spark.createDataFrame(items, "item_id long, passage string")
    assert {tuple(r) for r in p9.leaks(df, it).collect()} == want
    # the same when the items are too many for a broadcast
    assert {tuple(r) for r in p9.leaks(df, it, most_words=0).collect()} == want
    assert p9.joined_leaks(df, it.where("false").where("passage <> ''")).count() == 0
    assert p9.leaks(df, it.where("false")).count() == 0 and p9.leaks(df.where("false"), it).count() == 0


def test_leak_words():
    assert p9.words("1,325 peo-\nple сау “Hi”") == ["1325", "people", "cay", "hi"]
    assert p9.words("3\u202f688 and 12 345 of 20 12 1990") == ["3688", "and", "12345", "of", "20", "12", "1990"]


def test_size_classes():
    for n in range(1, 4000):
        c, k, w = p9.size_class(n)
        need = -(-n // 2)
        # every run that matters holds a window, and no run of the partition is much longer than its window
        assert k + w - 1 <= need < 1.5 * (k + w - 1) + 1 and k == min(5, k + w - 1)
        assert p9.size_class(n)[1:] == (k, w)


# --- problem 10 -------------------------------------------------------------


def test_quality(spark):
    prose = ["The people of the town said that it was not the first time that the river had been so high in the spring, and they were not sure what to do about it. " * k for k in range(1, 31)]
    odd = ["\n".join(["Topics"] + [f"- red {w}" for w in "apple pear plum grape cherry".split()]), "\n".join(["a\tM\tSD"] + [f"v{i}\t{i}.5\t.{i}2" for i in range(1, 9)]), "qwrt zxcvb mnbvc dfghj " * 9, "!?;: &%/ " * 30, "Home\nLog in\nMenu\nShare\nHome", None, ""]
    got = {r["doc_id"]: r["doc_class"] for r in p10.document_quality(docs(spark, prose + odd, variety="clash")).collect()}
    assert all(got[i] == "prose" for i in range(30))
    assert [got[i] for i in range(30, 37)] == ["list", "table", "junk", "junk", "junk", "prose", "prose"]
    assert p10.document_quality(docs(spark, []).where("false")).count() == 0


def test_common_words_of_a_language_without_a_list(spark):
    rng = random.Random(4)
    small = "ja on ei se kun niin myös oli".split()
    prose = [" ".join(x for _ in range(30) for x in (rng.choice(small), "".join(rng.choice("aeiklmnpstu") for _ in range(7)))) + "." for _ in range(60)]
    lists = ["\n".join(f"- {''.join(rng.choice('aeiklmnpstu') for _ in range(7))} {''.join(rng.choice('aeiklmnpstu') for _ in range(8))}" for _ in range(9)) for _ in range(20)]
    d = spark.createDataFrame([(i, t, "FI") for i, t in enumerate(prose + lists)], "doc_id long, text string, lang string")
    assert set(small) <= set(p10.learned_common(d)["fi"].split())
    got = {r["doc_id"]: r["doc_class"] for r in p10.document_quality(d).collect()}
    assert [got[i] for i in range(80)] == ["prose"] * 60 + ["list"] * 20


PROSE_WORDS = "group lines house people river study model result effect sample".split()


def _prose(rng):
    return " ".join(w for _ in range(40) for w in (rng.choice(p10.COMMON["en"].split()), rng.choice(PROSE_WORDS), *rng.sample(["and", "shyness", "quiet", "measured"], rng.randint(1, 2)))) + "."


@pytest.mark.parametrize("share", [1 / 3, 0.6])
def test_quality_with_many_lists_and_tables(spark, share):
    rng = random.Random(5)
    kinds = ["list" if k % 2 else "table" for k in range(int(120 * share))]
    make = {"list": lambda: "\n".join(f"- {rng.choice(PROSE_WORDS)} {rng.choice(PROSE_WORDS)}" for _ in range(9)), "table": lambda: "\n".join(f"v{i}\t{rng.random():.2f}\t{rng.random():.2f}" for i in range(9))}
    texts = [make[k]() for k in kinds] + [_prose(rng) for _ in range(120 - len(kinds))]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(1000 + i, make["list"](), "") for i in range(40)] + [(2000 + i, make["list"](), "fr") for i in range(30)] + [(3000 + i, _prose(rng), "") for i in range(150)]
    got = {r["doc_id"]: r["doc_class"] for r in p10.document_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i] for i in range(120)] == kinds + ["prose"] * (120 - len(kinds))
    assert all(got[i] == ("prose" if i >= 3000 else "list") for i in got if i >= 1000)


def test_quality_of_long_and_wide_tables_and_lists(spark):
    rng = random.Random(7)
    name = lambda n: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(n // 2))
    long = "\n".join(f"{name(10)}; 3; 5; 2; 4" for _ in range(5000))
    wide = "\n".join("\t".join([f"v{i}", *(f"{rng.random():.3f}" for _ in range(80))]) for i in range(6))
    books = "\n".join(f"{i}. {' '.join(name(8) for _ in range(45))}." for i in range(1, 9))
    assert min(map(len, [*wide.split("\n"), *books.split("\n")])) > 300
    got = p10.document_quality(docs(spark, [_prose(rng) for _ in range(40)] + [long, wide, books])).orderBy("doc_id").collect()
    assert [r["doc_class"] for r in got] == ["prose"] * 40 + ["table", "table", "list"]
    assert 0.28 < got[40]["digit_ratio"] < 0.29


def test_statistics_query_returns_all_columns(spark, tmp_path):
    docs(spark, ["The people said so.\nIt was."], source="x").write.parquet(f"{tmp_path}/documents.parquet")
    r = p10.p10_statistics(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0]["n_words"], r[0]["n_lines"], r[0]["line_end_share"]) == (6, 2, 1.0) and r[0]["mean_word"] == 20 / 6
    assert {*p10.STATS, *(f"z_{s}" for s in p10.STATS)} <= {*r[0].asDict()} and r[0]["z_common_share"] is not None


def test_statistics_compute_nothing_twice(spark):
    """Nothing is put into a projection of its own for a denominator, and quotation marks and dashes set off no translation."""
    d = docs(spark, ["“It’s so” – they said … «no»"])
    assert "_common_expr" not in p10.text_statistics(d)._jdf.queryExecution().optimizedPlan().toString()
    looks = "".join(p10.TO_LATIN) + p10.IGNORABLE + "\uff01\uff5e"
    assert not d.select(F.col("text").rlike(p10._spans(looks))).first()[0]
    assert all(r[0] for r in docs(spark, list(looks)).select(F.col("text").rlike(p10._spans(looks))).collect())


def test_statistics_of_odd_texts_against_python(spark):
    odd = ["a\fb.\r\nc,  \u00a0 d\t1 | 2\n \n", "He said “no.”) »\n(yes!\n.)x\n…'\n)", "v1, 2; 3\n4\t5\t6\n7    8,    9\nsoft\u00adly ａ１！ сору", " \r\f\n", "Log in\nLOG IN \nlog\u0130n\n" + "x" * 40, "é½Ⅳ٣ 100% \u2028 –"]
    char = dict(zip(p10.TO_LATIN, p10.TO_LATIN.values())) | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys(p10.IGNORABLE, "")
    for r, text in zip(p10.text_statistics(docs(spark, odd)).orderBy("doc_id").collect(), odd):
        t = "".join(char.get(c, c) for c in text)
        alnum = "".join(c for c in t.lower() if unicodedata.category(c)[0] in "LN")
        solid = sum(c not in " \n\t\f\r\u00a0" for c in t)
        lines = [x for x in (x.strip(" ") for x in re.split(r"[\n\f\r]", t)) if x]
        share = lambda part, whole: part / whole if whole else 0.0
        cells = lambda x: len(re.findall(p10.CELLS, x)) >= 2 and sum(not (c.isascii() and c.isalpha()) for c in x.replace(" ", "")) >= 0.4 * len(x.replace(" ", ""))
        assert r["n_lines"] == len(lines)
        assert r["symbol_ratio"] == share(solid - len(alnum), solid)
        assert r["digit_ratio"] == share(sum(c in "0123456789" for c in alnum), len(alnum))
        assert r["vowel_ratio"] == share(sum(c in p10.VOWELS for c in alnum), len(alnum))
        assert r["line_end_share"] == share(sum(x.rstrip("\"'”’»)] ").endswith((".", "!", "?", "…", ":")) for x in lines), len(lines))
        assert r["column_share"] == share(sum(map(cells, lines)), len(lines))
        assert r["control_share"] == share(sum(x.lower() in p10.CONTROLS.split("|") for x in lines), len(lines))
