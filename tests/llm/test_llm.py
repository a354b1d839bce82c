"""Training-data operators against brute force, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import math
import os
import random
import re

import numpy as np
import pytest

from tarnsearch.functions.text import py_terms
from tarnsearch.llm import frequency, mainbody, mixing, neardup, packing, quality, ranking, residue, sitelines, spam, tokens
from tarnsearch.llm.lines import kind

VOCABULARY = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer files")
#: Columns named like the operators' own.
CLASH = "site string, line string, docs long, term string, a long, rep long, words int, window long, _text string, block int, label double"
CLASHING = ("s", "l", 1, "t", 2, 3, 4, 5, "x", 6, 0.5)


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], f"{schema}, {CLASH}")


def pages(n, site="a.example", seed=1):
    rng = random.Random(seed)
    for i in range(n):
        yield i, f"http://{site}/p{i}", "\n".join([f"unique {seed} {rng.random()} line"] + (["Legal  NOTICE 20%02d" % (i % 90)] if i % 2 else []) + ["Back to top"] * 2)


# problem 1


def brute_lines(rows, least=5):
    seen = collections.defaultdict(set)
    for i, uri, body in rows:
        m = re.match(r"https?://([^/:]+)", (uri or "").lower())
        if not m or body is None or i is None:
            continue
        for x in body.split("\n"):
            x = re.sub(r"[ \t\r]+", " ", re.sub("[0-9]+", "#", x.lower())).strip(" ")
            if x:
                seen[m[1].rstrip("."), x].add(i)
    return {k for k, v in seen.items() if len(v) >= least}


def test_repeated_lines(spark):
    rows = [*pages(30), *((i + 100, u, b) for i, u, b in pages(20, "B.Example.", 2)), *((i + 200, f"http://one{i}.example/", b) for i, _, b in pages(40, seed=3))]
    rows += [(500, None, "Back to top"), (501, "http://a.example/x", None), (502, "http://a.example/y", ""), (None, "http://a.example/z", "Back to top"), (0, "http://a.example/p0", rows[0][2])]
    df = frame(spark, rows, "doc_id long, uri string, body string")
    got = sitelines.repeated_lines(df, kinds=("excess", "shared")).collect()
    assert {(r["site"], r["line"]) for r in got} == brute_lines(rows)
    kinds = {(r["site"], r["line"]): r["kind"] for r in got}
    assert kinds["a.example", "back to top"] == "shared"  # as frequent everywhere
    only = {(r["site"], r["line"]) for r in sitelines.repeated_lines(df).collect()}
    assert only == {k for k, v in kinds.items() if v == "excess"}


def test_excess_is_told_from_shared(spark):
    rows = [(i, "http://own.example/x", f"u{i}\nonly here") for i in range(50)] + [(100 + i, f"http://s{i % 9}.example/", f"v{i}") for i in range(300)]
    got = {r["line"]: r for r in sitelines.repeated_lines(frame(spark, rows, "doc_id long, uri string, body string")).collect()}
    assert got["only here"]["kind"] == "excess" and got["only here"]["llr"] > 100 and got["only here"]["outside_docs"] == 0


def test_false_discovery_cut():
    assert sitelines.false_discovery_cut([], 1, 0.01) == math.inf
    assert sitelines.false_discovery_cut([(0, 1000), (2, 10)], 1010, 0.01) == math.inf
    assert sitelines.false_discovery_cut([(0, 1000), (1000, 10)], 1010, 0.01) == pytest.approx(50.0)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_lines_are_removed_in_order(spark, monkeypatch, limit):
    from tarnsearch.llm import common

    monkeypatch.setattr(sitelines, "small_side", lambda df, rows, _=0: common.small_side(df, rows, limit))
    rows = [(i, "http://a.example/", f"first {chr(97 + i)}\nNOTICE  {i}\n\nlast {chr(97 + i)}") for i in range(8)]
    rows += [(90, "http://a.example/", None), (91, "http://a.example/", "notice 7"), (92, None, "notice 1"), (93, "http://b.example/", "notice 1\nx")]
    got = {r["doc_id"]: r["body"] for r in sitelines.remove_repeated_lines(frame(spark, rows, "doc_id long, uri string, body string"), kinds=("excess", "shared")).collect()}
    assert got[2] == "first c\n\nlast c" and got[90] is None and got[91] == "" and got[92] == "notice 1" and got[93] == "notice 1\nx" and len(got) == 12


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, uri string, body string, title string, links array<string>")
    assert sitelines.repeated_lines(docs).count() == sitelines.remove_repeated_lines(docs).count() == 0
    assert frequency.term_frequencies(docs).count() == neardup.similar_pairs(docs).count() == neardup.similar_groups(docs).count() == 0
    assert mainbody.surrounding_lines(docs, "doc_id", text_col="body").count() == 0
    page = spark.createDataFrame([], "page_id long, url string, title string, text string, links array<struct<href:string,text:string>>")
    assert residue.residue_pages(page).count() == spam.spam_pages(page).count() == residue.without_residue(page).count() == 0
    hits = spark.createDataFrame([], "qid string, scorer string, doc_id long, score double")
    projected = ranking.combined_hits(hits, spark.createDataFrame([], "doc_id long, rank double"))
    assert projected.count() == ranking.full_order(projected, "qid", "doc_id").count() == 0
    texts = spark.createDataFrame([], "doc_id long, text string, source string")
    words = spark.createDataFrame([("en", "the")], "lang string, word string")
    assert quality.judged(texts, words).count() == 0
    if os.path.exists(VOCABULARY):
        assert packing.packed(texts, spark.createDataFrame([("s", 10)], "container string, capacity_tokens int")).count() == 0
        assert mixing.mixture(texts, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")).count() == 0


# problem 2


PAGE = "\n".join(
    ["Home | News | Contact", "This site sets cookies. OK", "A quiet mill", "By Anna Berg", "Published 3 May 2020", "The mill stands by the river, and nobody has used it for years. It is old.", "", "Advertisement", "How the mill was lost", "Nobody knows, but the roof fell in last winter, after the storm.", "- the wheel", "- the stone", "You may also like: The bridge", "It may be built again, if the town agrees.", "Most read", "Why the bridge is closed", "The oven and the baker", "© 2020 Mill Media. All rights reserved.", "Back to top"]
)


def test_main_body(spark):
    rows = [(1, "A quiet mill", PAGE, [("/news", "News"), ("/b", "Why the bridge is closed")]), (2, None, None, None), (3, "", "", []), (4, "t", "Home\nNews\nSearch", None), (5, "A long one", "A long text, with a comma. " * 20_000, [])]
    df = frame(spark, rows, "page_id long, title string, text string, links array<struct<href:string,text:string>>")
    got = collections.defaultdict(set)
    for r in mainbody.surrounding_lines(df, "page_id").collect():
        got[r["rec_id"]].add(r["line_no"])
    assert got[1] == {0, 1, 7, 12, 14, 15, 16, 17, 18} and got[4] == {0, 1, 2} and 5 not in got
    main = {r["rec_id"]: r["main_text"] for r in mainbody.main_texts(df, "page_id").collect()}
    assert set(main) == {1, 3, 4, 5} and main[4] == "" and main[1].startswith("A quiet mill") and len(main[5]) == len(rows[4][2])


ARTICLE = ["A quiet mill", "The mill stands by the river, and nobody has used it for years, as far as the town can tell.", "Its roof fell in last winter, after the storm, and the flood took the wheel in spring."]
TEASER = ["Was the bridge, the old one, closed for good?", "- Two bakers share one oven."]
TEASER_LINKS = [("/bridge", TEASER[0]), ("/oven", "Two bakers share one oven")]


@pytest.mark.parametrize(
    ("rest", "links", "dropped"),
    [
        (["Advertisement", *TEASER, "Back to top"], TEASER_LINKS, {3, 4, 5, 6}), (["Advertisement", "Was the bridge closed for good?", "Back to top"], [("http://a.example/was-the-bridge-closed-for-good", "")], {3, 4, 5}),
        (["Most read", "Was the bridge closed for good?"], [("/b", "Was the bridge closed for good?")], {3, 4}), (["Advertisement", *TEASER, "Share this page: Mail | Print", "It may be built again, if the town agrees."], TEASER_LINKS, {3, 4, 5, 6}),
        (["", "- the wheel.", "- the stone.", "Back to top"], [("/w", "the wheel"), ("/s", "the stone")], {6}), (["Advertisement", "That is all we know."], [("/m", "mill")], {3}),
    ],
)
def test_linked_containers_are_surroundings(rest, links, dropped):
    text = "\n".join(ARTICLE + rest)
    assert set(mainbody.PageTree().surroundings(text, ARTICLE[0], [t for _, t in links], [h for h, _ in links])) == dropped


@pytest.mark.parametrize(
    ("line", "expected"),
    [("Contact > Shop > Kettle", "nav"), ("* Help centre", "nav"), ("Home Shop Forum About us", "nav"), ("Liked it? Pass it on to a friend", "share"), ("Meistgelesen", "pointer"), ("À lire aussi", "pointer"), ("Most read: The oven", "pointer_to"),
     ("Für Inhalte fremder Seiten haftet Wutz nicht.", "legal"), ("Words: Anna Berg", "byline"), ("12. März 2020", "date"), ("The footer says all rights reserved, yet nobody reads it to the end of the line.", "sentence"), ("let x = mill.wheel(3);", "code")],
)
def test_line_kinds(line, expected):
    assert kind(line) == expected


@pytest.mark.parametrize("times", [1, 3, 45])
def test_notices_of_every_length_are_told(times):
    cookie = "This site sets cookies to remember you and to count visits. Manage your cookies in the settings or accept them all. "
    assert kind((cookie * times).strip()) == "cookie"
    assert kind((cookie + "We store small files for that, and our partners read them when you come back to any of our pages, as they do elsewhere.").strip()) == "cookie"
    assert kind(("The mill stands by the river and nobody has used it. " * 8 * times + "It uses cookies to store its settings.").strip()) == "sentence"


# problem 3


def test_term_frequencies(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the"] * 30 + [f"w{rng.randrange(300)}", "Años"]) for _ in range(rng.randrange(40)))) for i in range(200)] + [(900, None), (901, ""), (902, "the " * 50_000), (3, "x"), (None, "y")]
    rows = [r for r in rows if r[0] != 3] + [(3, "again x"), (3, "again x")]
    df = frame(spark, rows, "doc_id long, body string")
    total, docs = collections.Counter(), collections.Counter()
    by_id = {i: t for i, t in rows if i is not None and t is not None}
    for t in by_id.values():
        total.update(py_terms(t))
        docs.update(set(py_terms(t)))
    n = len(by_id)
    want = {t: (total[t], docs[t], "rare" if docs[t] <= 2 else "common" if docs[t] > 0.67 * n else None) for t in total}
    for options in ({}, {"heavy_terms": 3, "table_size": 5, "sample_rows": 20}, {"heavy_share": 2.0}):
        got = frequency.term_frequencies(df, **options).collect()
        assert {r["term"]: (r["total_count"], r["doc_freq"], r["mark"]) for r in got} == want and len(got) == len(want)


def test_reports_agree(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, body string")
    stats = spark.createDataFrame([(0, "a", 1, 5), (0, "a", 9, 4), (1, "a", 1, 5), (1, "b", None, 9)], "shard int, term string, doc_freq long, reported_at int")
    got = {r["term"]: (r["reported_docs"], r["agrees"]) for r in frequency.frequencies_with_reports(docs, stats).collect()}
    assert got == {"a": (2, True), "b": (None, None)}


# problem 4


GOOD = "The mill stands by the river. Nobody has used it for years, and the roof is gone."


def page_frame(spark, rows, sites=7):
    return frame(spark, [(i, f"http://s{i % sites}.example/", t, x) for i, t, x in rows], "page_id long, url string, title string, text string")


def test_residue(spark):
    rows = [
        (1, "Just a moment", GOOD), (2, "Mill", f"{GOOD} The {{{{ owner }}}} sold it."), (3, "Mill", "Home\nPlease enable JavaScript to continue.\nLoading..."), (4, "Mill", GOOD),
        (5, "Mill", f"{GOOD} A template such as ${{name}} must be filled first. Designers put lorem ipsum into drafts."), (6, "Mill", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."),
        (7, None, "Access denied. You have no permission."), (8, "Access denied", None), (9, "${title} | Mill", GOOD), (10, "Mill", f"{GOOD}\nError 503: the server could not complete the request"), (11, "Mill", "[object Object]\nNaN items in cart"),
        *((20 + i, "Mill", "Please wait.") for i in range(4)), (30, "Mill", ""), (4, "Mill", GOOD),
        # the same forms on other sites
        (41, "Just a moment - Tower", GOOD), (43, "Tower", "Please enable JavaScript to continue.\nLoading..."), (45, "Tower", "NaN items in cart"), (46, "Tower", "Error 502: the server could not complete the request"),
        # a notice that no other site carries
        (60, "Tower", "The database of the ferry office failed with code 7 again."),
    ]
    df = page_frame(spark, rows)
    got = {r["page_id"]: r["reason"] for r in residue.residue_pages(df).collect()}
    assert got == {**dict.fromkeys((1, 41), "title"), **dict.fromkeys((2, 9), "placeholder"), 11: "placeholder", 6: "filler", **dict.fromkeys((3, 20, 21, 22, 23, 43, 45, 46), "message")}
    clean = residue.without_residue(df)
    assert {r["page_id"] for r in clean.collect()} == {4, 5, 7, 8, 10, 30, 60} and clean.columns == df.columns


@pytest.mark.parametrize("size", [1, 40])
def test_messages_of_every_length_are_counted(spark, size):
    notice = "Error 503: the server could not complete the request because its store did not answer in time, so nothing was sent. " * size
    rows = [(i, "Mill", notice.replace("503", str(500 + i))) for i in range(3)] + [(10, "Mill", f"{GOOD} Once it said: {notice[:60]} and we wrote it down.")]
    assert {r["page_id"] for r in residue.residue_pages(page_frame(spark, rows)).collect()} == {0, 1, 2}


def test_recurrence_alone_or_a_phrase_alone_is_no_message(spark):
    rows = [(i, "Mill", "A short text that many sites carry") for i in range(6)] + [(20, "Mill", "This page could not be found on the old river server")]
    assert residue.residue_pages(page_frame(spark, rows)).count() == 0
    assert [residue.wide(n) for n in (0, 1, 7, 204, 10**6)] == [2, 2, 2, 3, 7]


@pytest.mark.parametrize(
    ("line", "expected"),
    [("404 - the page you asked for could not be found", "missing"), ("Bad gateway. Reference 08ff92ca5d4a", "server"), ("xxxx xxx xxxxx", "repeat"), ("at mill.wheel (a.js:3:4)", "frame"), ("Heading 4", "skeleton"), ("Back soon", "bare"), ("The mill stands by the river.", None), ("", None)],
)
def test_phrase_rules(line, expected):
    assert residue.rule(line) == expected


def test_masks():
    assert residue.mask("Undefined variable: mill in /srv/app/mill.tpl on line 4") == residue.mask("Undefined variable: ferry in /srv/b.tpl on line 71")
    assert residue.mask("Posted by {{ author }} on 3 May 2020, see a@b.example") == "posted by {} on §, see @"


# problem 5


def test_spam(spark):
    rng = random.Random(2)
    names, verbs = ["mill", "river", "tower", "oven", "ferry", "lamp", "bridge", "baker"], ["sees", "moves", "holds", "finds", "leaves"]
    prose = lambda n: " ".join(f"The {rng.choice(names)} {rng.choice(verbs)} a {rng.choice(names)}{rng.randrange(999)} and then the {rng.choice(names)} {rng.choice(verbs)} it." for _ in range(n))
    rows = [(i, prose(12)) for i in range(60)]
    rows += [
        (100, "cheap lamp price " * 80), (101, "\n".join(f"Best lamp service in Town{i % 9}, call now for a lamp in Town{i % 9}." for i in range(60))), (102, "Tags: " + ", ".join(f"{rng.choice(names)} {rng.randrange(99)}" for _ in range(60))),
        (103, "\n".join(f"https://x{i}.example/lamp - tower" for i in range(40))), (104, prose(8) + "\n- the mill\n- one river\n- a tower"), (105, None), (106, ""), (107, "Home\nNews"), (108, "buy"), (100, "cheap lamp price " * 80),
    ]
    found = {r["page_id"] for r in spam.spam_pages(frame(spark, rows, "page_id long, text string")).collect()}
    assert found == {100, 101, 102, 103}
    titles = [f"{rng.choice(names).title()} and {rng.choice(names)} {n}?" for n in range(40)]
    linked = [(i, x, [("/a", "Home")]) for i, x in rows] + [(200, "\n".join(titles), [("/t", t) for t in titles]), (201, prose(9), [("/t", "mill"), (None, None)])]
    again = spam.spam_pages(frame(spark, linked, "page_id long, text string, links array<struct<href:string,text:string>>"))
    assert {r["page_id"] for r in again.collect()} == {100, 101, 102, 103, 200}


@pytest.mark.parametrize("size", [1, 511, 512, 513, 2048, 2049, 2560, 2561, 4600, 6144])
def test_blocks_hold_all_bytes(size):
    data = random.Random(size).randbytes(size)
    blocks = spam._blocks(data)
    assert b"".join(blocks) == data and all(b for b in blocks) and max(map(len, blocks)) <= 2560


def test_ratio_reads_the_end():
    rng = random.Random(3)
    text = "mill, " * 700 + " ".join(rng.choice(["the", "a", "of", "mill", "and", "3", "by", "-"]) for _ in range(250))
    ratio = lambda x: spam.measure(x, [], mainbody.Kinds(), spam.Shapes(), spam.Forms())[3]
    assert ratio(text) > ratio(text[:4200]) + 1


def test_no_length_or_word_limit_for_spam(spark):
    rng = random.Random(12)
    names, verbs = ["mill", "river", "tower", "oven", "ferry", "lamp", "bridge"], ["sees", "moves", "holds", "finds", "leaves"]
    ends = ["and nobody knows why.", "in the morning, or later.", "after all that was said about it.", "while it rains.", "as the old baker told us."]
    prose = [(i, " ".join(f"{rng.choice(['The', 'A', 'Our'])} {rng.choice(names)} {rng.choice(verbs)} the {rng.choice(names)} {rng.choice(ends)}" for _ in range(9))) for i in range(40)]
    rows = [*prose, (100, "lamp price " * 40_000), (101, "lamp, lamp, lamp, lamp, lamp, lamp, lamp, lamp, lamp, lamp, lamp"), (102, "buy"), (103, "Home\nNews")]
    assert {r["page_id"] for r in spam.spam_pages(frame(spark, rows, "page_id long, text string")).collect()} == {100, 101}


# problem 6


def near_texts(seed=4, families=25, others=40):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    for f in range(families):
        base = [word() for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(2, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 12)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(3)] = [word() for _ in range(rng.randrange(3))]
            rows.append(" ".join(copy))
    rows += [" ".join(word() for _ in range(120)) for _ in range(others)]
    return list(enumerate(rows))


def brute_pairs(rows, width, least):
    sets = {i: {tuple(t[k : k + width]) for k in range(len(t) - width + 1)} for i, t in ((i, py_terms(x)) for i, x in rows if x)}
    ids = [i for i in sets if sets[i]]
    return {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def closure(pairs, copies=()):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in [*pairs, *copies]:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize(("width", "least"), [(3, 0.5), (5, 0.8)])
def test_near_duplicates(spark, width, least):
    rows = near_texts() + [(1000, None), (1001, ""), (1002, "two words"), (2000, "long text " + "x y z " * 20_000)]
    copies = [(3000 + i, rows[0][1]) for i in range(3)]
    df = frame(spark, [*rows, *copies, rows[5]], "doc_id long, body string")
    got = {(r["doc_a"], r["doc_b"]) for r in neardup.similar_pairs(df, width=width, similarity=least).collect()}
    want = brute_pairs(rows, width, least)
    own = {(0, c) for c, _ in copies}
    assert own <= got and got - own <= want and len(want - got) <= 0.01 * len(want) + 0.5
    groups = {r["doc_id"]: r for r in neardup.similar_groups(df, width=width, similarity=least).collect()}
    assert len(groups) == len(rows) + len(copies)
    roots = closure(got)
    assert {i: g["class_id"] for i, g in groups.items()} == {i: roots.get(i, i) for i in groups}
    sizes = collections.Counter(g["class_id"] for g in groups.values())
    assert groups[1000]["class_size"] == 1 and all(g["class_size"] == sizes[g["class_id"]] for g in groups.values())


def test_large_buckets_lose_no_pair(spark):
    df = spark.createDataFrame(near_texts(9, 12, 5), "doc_id long, body string")
    table = neardup.sketches(df, "doc_id", "body", 3, 16, 1, 16, 1)
    pairs = {size: {tuple(r) for r in neardup.candidate_pairs(table, size).collect()} for size in (2, 3, 10_000)}
    assert pairs[2] == pairs[3] == pairs[10_000] and pairs[2]


def test_a_family_of_edited_copies_is_linked_without_its_pairs(spark):
    """Every text is a version of one; links stay few and every document divisible by 50 has its class, checked against all rows."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    rows = []
    for i in range(600):
        copy = list(base)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, body string").repartition(4)
    links, _ = neardup.star_links(df)
    assert links.count() < 60 * len(rows)
    groups = {r["doc_id"]: r["class_id"] for r in neardup.similar_groups(df).collect()}
    sets = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in ((i, x.split()) for i, x in rows)}
    near = [(a, b) for a in range(0, 600, 50) for b in sets if b != a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert near and sum(groups[a] == groups[b] for a, b in near) >= 0.99 * len(near)


def test_versions_of_a_later_text_share_its_class(spark):
    """Each version is similar only to the text with the greatest id, which other versions meet first in every bucket."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    rows = [(40, " ".join(base))]
    for i in range(40):
        copy = list(base)
        for at in rng.sample(range(3, 297), 6):
            copy[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    pairs = brute_pairs(rows, 5, 0.8)
    groups = {r["doc_id"]: r["class_id"] for r in neardup.similar_groups(spark.createDataFrame(rows, "doc_id long, body string").repartition(4)).collect()}
    assert len(pairs) >= 30 and groups == {i: closure(pairs).get(i, i) for i, _ in rows}


def test_links_connect_what_pairs_connect(spark):
    """In few and crowded bands, every candidate counts: the links have the classes of all pairs, in small and in cut buckets."""
    for seed in range(2):
        rng = random.Random(seed)
        df = spark.createDataFrame([(i, " ".join(rng.sample([f"t{k}" for k in range(9)], 5))) for i in range(14)], "doc_id long, body string")
        options = {"width": 1, "similarity": 0.5, "bands": 6, "rows": 1, "signature": 6, "seed": seed}
        pairs = [(r["a"], r["b"]) for r in neardup.similar_classes(df, **options)[0].collect()]
        for rounds, size in ((4, 2000), (1, 2)):
            links = [(r["a"], r["b"]) for r in neardup.star_links(df, **options, rounds=rounds, bucket_rows=size)[0].collect()]
            assert set(links) <= set(pairs) and closure(links) == closure(pairs)


def test_a_link_at_the_threshold_outlasts_an_unlucky_signature(spark):
    """With this seed 133 of 192 bytes agree where 0.8 are expected."""
    df = spark.createDataFrame([(i, " ".join(f"t{k}" for k in range(10 * i, 90 + 10 * i))) for i in range(2)], "doc_id long, body string")
    assert [tuple(r) for r in neardup.star_links(df, width=1, seed=819)[0].collect()] == [(0, 1)]


def test_pairs_across_classes(spark):
    rng = random.Random(3)
    rows = [(i, key, 100 * (i % 5 > 2) * (i % 5)) for key, n in ((1, 23), (2, 6), (-3, 2), (4, 1)) for i in rng.sample(range(40), n)]
    want = {(i, j) for i, k, c in rows for j, m, d in rows if i < j and k == m and c != d}
    df = spark.createDataFrame(rows, "id long, key long, c long")
    for size in (2, 5, 100):
        got = [tuple(r) for r in neardup._pairs_across(df, size).collect()]
        assert len(got) == len(want) and set(got) == want


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(500, 501), (501, 500), (500, 500)]
    got = {r["id"]: r["component"] for r in neardup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == closure(edges)


# problem 7


def test_ranks_in_ranges_equal_plain_ranks(spark):
    rng = random.Random(1)
    rows = [("hot", i, rng.choice([None, 1.0, 2.0, rng.random()])) for i in range(500)] + [("cold", i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    read = lambda d: {(r["g"], r["i"]): (r["rank_lo"], r["ties"], r["group_rows"]) for r in d.collect()}
    assert read(ranking.grouped_ranks(df, ["g"], "v", 50)) == read(ranking.grouped_ranks(df, ["g"], "v"))
    level = spark.createDataFrame([("hot", i, None if i % 3 else 1.0) for i in range(400)], "g string, i long, v double")
    assert read(ranking.grouped_ranks(level, ["g"], "v", 50)) == read(ranking.grouped_ranks(level, ["g"], "v"))


def test_order_of_a_hot_group_of_ties(spark):
    rows = [("hot", i, 0.5 if i % 4 else float(i)) for i in range(300)] + [("cold", i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, i long, projection double")
    want = {(g, i): n + 1 for g in ("hot", "cold") for n, (_, i) in enumerate(sorted((-v, i) for h, i, v in rows if h == g))}
    for limit in (20, 10**6):
        assert {(r["g"], r["i"]): r["position"] for r in ranking.full_order(df, "g", "i", limit).collect()} == want


def test_every_loading_takes_its_declared_direction(spark):
    df = spark.createDataFrame([(float(i), float(i * i), float(-i)) for i in range(20)], "x double, y double, z double")
    _, _, v = ranking.first_component(df, ["x", "y", "z"], [1, 1, 1])
    assert min(v) > 0


def test_combined_ranking_ignores_scale(spark):
    rng = np.random.default_rng(3)
    true = rng.normal(size=80)
    make = lambda f: [("q", k, i, float(v)) for k, v0 in f.items() for i, v in enumerate(v0)]
    kinds = {"body": true + rng.normal(size=80) * 0.4, "title": true + rng.normal(size=80) * 0.4, "anchor": true + rng.normal(size=80) * 0.4}
    stored = spark.createDataFrame([(i, float(t + 5)) for i, t in enumerate(true)] + [(0, 0.0), (None, 1.0)], "doc_id long, rank double")
    extra = [("q", "body", 3, None), ("q", "body", 4, -99.0), (None, "body", 1, 1.0), ("q", "title", None, 1.0), ("q", "body", 900, None)]
    one = spark.createDataFrame(make(kinds) + extra, "qid string, scorer string, doc_id long, score double")
    scaled = spark.createDataFrame(make({**kinds, "title": np.exp(5 * kinds["title"]), "anchor": 1e6 * kinds["anchor"]}) + extra, "qid string, scorer string, doc_id long, score double")
    a, b = ({r["doc_id"]: r["projection"] for r in ranking.combined_hits(x, stored).collect()} for x in (one, scaled))
    assert a == pytest.approx(b) and len(a) == 81
    assert np.corrcoef([a[i] for i in range(80)], true)[0, 1] > 0.9
    order = ranking.full_order(ranking.combined_hits(one, stored, 20), "qid", "doc_id", 20).collect()
    assert [r["doc_id"] for r in sorted(order, key=lambda r: r["position"])] == sorted(a, key=lambda i: (-a[i], i)) and sorted(r["position"] for r in order) == list(range(1, 82))
    assert [r["doc_id"] for r in ranking.head(ranking.combined_hits(one, stored), "qid", "doc_id", 10).orderBy("position").collect()] == sorted(a, key=lambda i: (-a[i], i))[:10]


def test_component_is_oriented_and_constant_columns_weigh_nothing(spark):
    df = spark.createDataFrame([(float(i), float(-i), 1.0) for i in range(10)], "x double, y double, z double")
    _, _, v = ranking.first_component(df, ["x", "y", "z"], [1, -1, 1])
    assert v[0] > 0 > v[1] and v[2] == 0
    _, _, v = ranking.first_component(df, ["z"], [-1])
    assert v == [-1.0]


# problem 8


def test_fill_is_optimal():
    rng = random.Random(6)
    for _ in range(60):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(1, 80)
        sums = {0}
        for s in sizes:
            sums |= {x + s for x in sums if x + s <= room}
        chosen = packing.fill(dict(collections.Counter(sizes)), room)
        assert sum(s * n for s, n in chosen.items()) == max(sums) and all(n <= sizes.count(s) for s, n in chosen.items())


def test_pack_keeps_every_item():
    rng = random.Random(7)
    sizes = [rng.randrange(1, 512) for _ in range(2000)]
    bins = packing.pack(sizes, 512)
    assert sorted(i for b in bins for i in b) == list(range(2000)) and all(sum(sizes[i] for i in b) <= 512 for b in bins)
    assert sum(sizes) / (512 * len(bins)) > 0.99
    assert packing.pack([], 5) == [] and packing.pack([5, 5, 1], 5) == [[0], [1], [2]]


@needs_vocabulary
def test_packed_texts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["mill", "river", "tower"]) for _ in range(rng.randrange(1, 120)))) for i in range(150)] + [(900, None), (901, ""), (902, "mill river " * 400), (1, "x"), (None, "y")]
    rows = [r for r in rows if r != (1, "x")]
    spec = spark.createDataFrame([("small", 64), ("small", 64), ("large", 300), (None, 5), ("none", 0)], "container string, capacity_tokens int")
    out = packing.packed(frame(spark, rows + rows[:1], "doc_id long, text string"), spec, window_items=40).collect()
    enc = tokens.encoding(VOCABULARY)
    for name, capacity in (("small", 64), ("large", 300)):
        mine = [r for r in out if r["container"] == name]
        held = collections.Counter()
        fill = collections.Counter()
        for r in mine:
            held[r["doc_id"]] += r["tokens"]
            fill[r["bin"]] += r["tokens"]
        assert held == {i: len(enc.encode_ordinary(t)) for i, t in rows if i is not None and t} and max(fill.values()) <= capacity
        parts = collections.Counter(r["doc_id"] for r in mine)
        assert all(n == 1 for i, n in parts.items() if held[i] <= capacity) and parts[902] == -(-held[902] // capacity)
    assert {r["container"] for r in out} == {"small", "large"}


# problem 9


def test_split_tree_is_exact():
    rng = np.random.default_rng(1)
    quotas = np.array([5, 0, 17, 300])
    for shards in (1, 2, 7):
        out = mixing.split_tree(quotas, shards, rng)
        assert out.shape == (shards, 4) and (out.sum(axis=0) == quotas).all() and (out >= 0).all() and np.ptp(out.sum(axis=1)) <= shards


def test_quotas():
    assert mixing.quotas({"a": 100, "b": 100}, {"a": (0.5, 1), "b": (0.5, 3), "c": (0.2, 1)}) == {"a": 100.0, "b": 100.0}
    assert mixing.quotas({}, {"a": (1.0, 1)}) == {}


@needs_vocabulary
def test_mixture(spark):
    rng = random.Random(9)
    rows = []
    for s, n in (("Big-one", 600), (" big one", 20), ("small", 40), ("tiny", 12), ("other", 30), (None, 5)):
        rows += [(len(rows) + i, "mill " * rng.randrange(5, 60), s) for i in range(n)]
    rows += [(9000, None, "small"), (9001, "", "small"), rows[0]]
    target = spark.createDataFrame([("big_one", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.2, 10), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    df = frame(spark, rows, "doc_id long, text string, source string")
    mixed = mixing.mixture(df, target, shards=5).cache()
    again = mixing.mixture(df, target, shards=5)
    out = mixed.collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again.collect()))
    uses = collections.Counter(r["doc_id"] for r in out)
    source = {r["doc_id"]: r["source"] for r in out}
    most = {"big_one": 1, "small": 3, "tiny": 10}
    assert all(n <= most[source[i]] for i, n in uses.items()) and {r["shard"] for r in out} == set(range(5))
    assert len({(r["doc_id"], r["use_no"]) for r in out}) == len(out)
    for s in range(5):
        assert sorted(r["position"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    shares = {r["source"]: r for r in mixing.share_report(mixed, target).collect()}
    total = sum(r["tokens"] for r in out)
    for s, t in (("big_one", 0.5), ("small", 0.3), ("tiny", 0.2)):
        assert abs(shares[s]["actual_share"] - t) < 60 / total + 1e-6 and shares[s]["most_uses"] <= most[s]
    assert shares["absent"]["actual_share"] == 0.0
    # the scarcest source is used up
    assert max(uses[i] for i in source if source[i] == "tiny") == 10 or max(uses[i] for i in source if source[i] == "small") == 3 or sum(source[i] == "big_one" for i in uses) == 620


@needs_vocabulary
def test_mixture_of_more_documents_than_blocks_can_plan(spark, monkeypatch):
    """Few blocks and groups for many documents: sub-blocks are split over the shards of each group."""
    monkeypatch.setattr(mixing, "BLOCKS", 8)
    monkeypatch.setattr(mixing, "GROUPS", 3)
    monkeypatch.setattr(mixing, "DOCS_PER_SHARD", 100)
    rng = random.Random(4)
    rows = [(i, "mill " * rng.randrange(1, 9), "big" if i % 3 else "small") for i in range(6000)]
    target = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mixture(df, target).cache()
    out = mixed.collect()
    assert len({(r["doc_id"], r["use_no"]) for r in out}) == len(out)
    sizes = collections.Counter(r["shard"] for r in out)
    assert len(sizes) >= 40 and max(sizes.values()) < 3 * len(out) / len(sizes) and min(sizes.values()) > 0
    shares = {r["source"]: r["actual_share"] for r in mixing.share_report(mixed, target).collect()}
    total = sum(r["tokens"] for r in out)
    assert all(abs(x - 0.5) < 20 / total for x in shares.values())


# problem 10


def test_judged_texts(spark):
    rng = random.Random(10)
    names, verbs = ["mill", "river", "tower", "oven", "ferry"], ["sees", "moves", "holds"]
    prose = lambda: " ".join(f"The {rng.choice(names)} {rng.choice(verbs)} a {rng.choice(names)} by the {rng.choice(names)}, and so it is." for _ in range(rng.randrange(1, 9)))
    junk = [lambda: "\n".join(f"* {rng.choice(names)} {rng.randrange(99)}" for _ in range(12)), lambda: " ".join(str(rng.random()) for _ in range(30)), lambda: "lamp " * 40, lambda: "\n".join(f"2024-01-0{rng.randrange(1, 9)}T00:00:00Z INFO {rng.choice(names)}::x y={rng.randrange(999)}" for _ in range(9))]
    rows = [(i, prose()) for i in range(120)] + [(500 + i, junk[i % 4]()) for i in range(80)] + [(900, None), (901, ""), (902, prose() + " And the mill is by the river. " * 9000), (0, "repeat")]
    words = spark.createDataFrame([("en", w) for w in "the a by and so it is".split()] + [(None, None)], "lang string, word string")
    rows = [r for r in rows if r != (0, "repeat")] + rows[:1]
    got = {r["doc_id"]: r for r in quality.judged(frame(spark, rows, "doc_id long, text string"), words, rounds=5).collect()}
    assert len(got) == 203
    assert all(got[i]["is_prose"] for i in range(120)) and not any(got[500 + i]["is_prose"] for i in range(80))
    assert got[900]["is_prose"] is None and got[900]["word_count"] is None and got[901]["is_prose"] is False and got[901]["word_count"] == 0 and got[902]["is_prose"]
    first = got[0]
    text = dict(rows)[0]
    assert first["word_count"] == len(text.split()) and first["mean_word_length"] == pytest.approx(sum(map(len, text.split())) / len(text.split())) and 0 < first["common_word_share"] < 1


def test_trees_are_right_where_the_rules_have_no_verdict(spark, data):
    """Accuracy on hand-checked texts that were neither fitted nor calibrated on, beside that of the weak rules."""
    import importlib.util

    from pyspark.sql import functions as F

    from tarnsearch.llm.holdout import HOLDOUT, ROWS
    from tarnsearch.session import table

    spec = importlib.util.spec_from_file_location("handchecked", os.path.join(os.path.dirname(__file__), "handchecked.py"))
    checked = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(checked)
    assert not {t for _, t in checked.TEXTS} & {t for _, t in (*HOLDOUT, *ROWS)}
    held = spark.createDataFrame([(-1 - n, t) for n, (_, t) in enumerate(checked.TEXTS)], "doc_id long, text string")
    known = [t for _, t in checked.TEXTS]
    docs = table(spark, data, "documents").select("doc_id", "text").where(~F.col("text").isin(known)).unionByName(held)
    words = table(spark, data, "common_word")
    got = {r["doc_id"]: r["is_prose"] for r in quality.judged(docs, words).where("doc_id < 0").collect()}
    rules = {r["doc_id"]: r["label"] for r in quality.text_statistics(held, words).withColumn("label", quality.weak_label()).collect()}
    right = sum(got[-1 - n] == (y == 0) for n, (y, _) in enumerate(checked.TEXTS))
    by_rule = sum(rules[-1 - n] == y for n, (y, _) in enumerate(checked.TEXTS))
    print(f"trees {right}, rules {by_rule} of {len(checked.TEXTS)}")
    assert right >= 0.95 * len(checked.TEXTS) and right > by_rule


def test_platt():
    a, b = quality.platt([-2.0, -1.0, 1.0, 2.0, -1.5, 1.5], [0, 0, 1, 1, 0, 1])
    assert a > 0 and abs(b) < 0.5
    assert all(map(math.isfinite, quality.platt([1.0, 1.0], [1, 1])))
