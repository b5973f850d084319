"""Language identification, extraction, quality rules and decontamination on small fixtures."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reconweave.llm import decontaminate, html_mincut, langid, line_quality

DATA = "/root/testdata/sf0.001"


def test_held_out_accuracy_and_spans(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out()))
    got = langid.identify(docs, model).withColumn("out", langid.held_out()).join(docs.select("doc_id", "lang"), "doc_id").filter("out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "中文"), (4, "中文")], "doc_id long, text string")
    rows = langid.identify(odd, model).collect()
    assert [r["lang_pred"] for r in rows if r["doc_id"] < 4] == ["und"] * 3
    assert all(r["lang_pred"] in model.languages for r in rows if r["doc_id"] == 4) and len(rows) == 5
    assert langid.identify(odd.limit(0), model).count() == 0
    assert langid.train(docs.limit(0)).languages == []
    halves = [docs.filter(f"lang = '{x}' and n_chars > 600").first()["text"][:500] for x in ("de", "en")]
    spans = langid.identify(spark.createDataFrame([(1, "\n".join(halves))], "doc_id long, text string"), model).first()["spans"]
    assert {s["lang"] for s in spans} == {"de", "en"} and spans[0]["from"] == 0


def test_viterbi_equals_step_by_step():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(0, 30, 5)
        at = np.concatenate([[0], np.cumsum(n)])
        s = -np.abs(rng.normal(0, 5, (at[-1], 3))).astype(np.float32)
        s -= s.max(axis=1, keepdims=True)
        out = langid.viterbi(s, at)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b > a:
                best = s[a].astype(float)
                for t in range(a + 1, b):
                    best = np.maximum(best, best.max() - langid.SWITCH) + s[t]
                own = s[np.arange(a, b), out[a:b]].sum() - langid.SWITCH * np.count_nonzero(np.diff(out[a:b]))
                assert abs(best.max() - own) < 1e-3


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies to give you the best experience on our site.</div>
<article><h1>The title</h1><p>First paragraph with <b>bold</b> &amp; more text that goes on for a while.<br>And a line.
<p>Second   one&nbsp;here, also with enough words to be read by somebody.</p><p>Short.</p></article>
<aside class="sidebar"><p>Popular posts that everybody has read this week, in order.</p></aside>
<section id="comments"><p>Great article, thank you so much for writing all of this!</p></section>
<form>Subscribe <input><button>Go</button></form><footer>&copy; 2026 Site</footer></body></html>"""


def test_article_without_boilerplate():
    want = "The title\n\nFirst paragraph with bold & more text that goes on for a while. And a line.\n\nSecond one here, also with enough words to be read by somebody.\n\nShort."
    assert html_mincut.main_text(PAGE) == want
    assert html_mincut.main_text(None) == html_mincut.main_text("") == html_mincut.main_text("<p") == ""


def test_elements_without_their_end_lose_no_text():
    want = html_mincut.main_text(PAGE)
    assert html_mincut.main_text(PAGE.replace("</head>", "")) == want
    for open_ in ("<svg/>", "<svg width=1 />", "<svg class=x>", "<math>", "<iframe src=x>"):
        assert html_mincut.main_text(PAGE.replace("<article>", f"{open_}<article>")) == want


def test_names_are_no_vetoes():
    want = html_mincut.main_text(PAGE)
    for tag in ('<article class="post has-sidebar">', '<article id="legal">', '<article class="story with-ads no-comments">', '<article title="a > b">', '<article title="x>', '<article title="a < b">'):
        assert html_mincut.main_text(PAGE.replace("<article>", tag)) == want, tag
    inside = '<section class="comments"><article class="comment"><p>' + "I liked this story and wish to say so here. " * 3 + "</p></article></section>"
    assert html_mincut.main_text(PAGE.replace("</body>", f"{inside}</body>")) == want


def test_hostile_pages_in_linear_time():
    import time

    for part in ("<a ", "<svg>", "<p title=\"<a ", "<p title='", "<div></b></p></section>", "<blockquote>x", "<!-- <", "<li><td>x", "<a \"<b\""):
        seconds = []
        for n in (50_000, 400_000):
            start = time.process_time()
            html_mincut.blocks(part * (n // len(part)))
            seconds.append(time.process_time() - start)
        assert seconds[1] < 24 * seconds[0] + 0.5, (part, seconds)


def test_cut_is_minimal():
    """Against all labellings of small pages."""
    found = html_mincut.blocks(PAGE)[:10]
    got = html_mincut.labels(found)

    def cost(labels):
        out = 0.0
        last = {}
        for i, b in enumerate(found):
            z = html_mincut.content_odds(b)
            out += np.log1p(np.exp(-z)) if labels[i] else np.log1p(np.exp(z))
            if i:
                out += (labels[i] != labels[i - 1]) * html_mincut.NEXT_TO / (1 + html_mincut._apart(found[i - 1].parent, b.parent) / 2)
            up = id(b.parent.parent or b.parent)
            if up in last:
                out += (labels[i] != labels[last[up]]) * html_mincut.SAME_PARENT
            last[up] = i
        return out

    best = min(cost([m >> i & 1 == 1 for i in range(len(found))]) for m in range(1 << len(found)))
    assert cost(got) <= best + 0.05


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (3, "u", "plain words only", "z")], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r for r in html_mincut.extract(pages).collect()}
    assert rows[2]["text"] == "" and rows[2]["n_chars"] == 0 and rows[1]["n_chars"] == len(rows[1]["text"])
    assert html_mincut.extract(pages.limit(0)).count() == 0


def test_line_measures_by_brute_force():
    texts = [None, "", "a b c a b c x", "x\nx\n \nx y\nx y", "one #two|three\t<é>", "w " * 400]
    got = line_quality.measures(pa.array([t or "" for t in texts]))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + d for k, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_frequent_lines_go(spark):
    body = " ".join(f"w{i}" for i in range(60))
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    rows = [(k, f"The common line {k}\n" + " ".join(f"{letters(k)}x{letters(i)}" for i in range(60)), "h") for k in range(120)]
    rows += [(500 + k, body, "g") for k in range(60)] + [(900, None, None), (901, body, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_quality.line_quality(docs, spark).collect()}
    assert all(got[k]["kept"] and got[k]["removed_chars"] > 0 for k in range(120))
    assert not any(got[500 + k]["kept"] for k in range(60)) and got[901]["kept"]
    assert got[900]["base_failed"] and not got[900]["kept"]
    assert line_quality.line_quality(docs.limit(0), spark).count() == 0


def test_limit_of_small_and_large_hosts(spark):
    """Of a host of 50, lines of more than 5 documents go; of 7, those of more than 5; of 5001, those of more than 500."""
    own = lambda h, k: " ".join(f"{h}{chr(97 + k // 676 % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}w{chr(97 + i // 8)}{chr(97 + i % 8)}" for i in range(60))
    hosts = {"a": (50, 5), "b": (50, 6), "c": (7, 5), "d": (7, 6), "e": (5001, 500), "f": (5001, 501)}
    rows = [(1000000 * j + k, ("shared notice\n" if k < m else "") + own(h, k), h) for j, (h, (n, m)) in enumerate(hosts.items()) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {r["h"]: r["n"] for r in line_quality.line_quality(docs, spark).filter("removed_chars > 0").selectExpr("doc_id div 1000000 AS h").groupBy("h").agg(F.count("*").alias("n")).collect()}
    assert gone == {1: 6, 3: 6, 5: 501}


def test_benchmark_passages(spark):
    item = " ".join(f"bench{i}" for i in range(30))
    near = item.replace("bench15 ", "other ")
    far = " ".join(f"bench{i}" if i % 3 else "x" for i in range(30))
    fill = " ".join(f"f{i}" for i in range(200))
    docs = [(1, f"{fill} {item.title()}, {fill}"), (2, item), (3, far), (4, None), (5, ""), (6, f"{near.replace('other', 'bench15')}!"), (7, fill), (8, "too short")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, item), (11, item), (12, None), (13, ""), (14, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench, spark).collect()}
    assert set(got) == {(i, j) for i in (1, 2, 6) for j in (10, 11)} | {(8, 14)}
    assert got[1, 10]["start_word"] == 200 and got[1, 10]["similarity"] == 1.0
    assert decontaminate.contaminated(docs, bench.limit(0), spark).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench, spark).count() == 0
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench, spark).collect()} == {3, 4, 5, 7}


def test_hamming_index_misses_nothing_within_its_radius():
    rng = np.random.default_rng(8)
    items = decontaminate.prepare([(k, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 20 + k % 9))) for k in range(90)])
    bits = np.unpackbits(items.prints.view(np.uint8).reshape(90, -1), axis=1).astype(bool)
    number = np.array([items.lengths.tolist().index(20 + k % 9) for k in range(90)])
    for far in (0, 1, 13, decontaminate.RADIUS, decontaminate.RADIUS + 1):
        for _ in range(20):
            turned = bits.copy()
            for row in turned:
                at = rng.choice(decontaminate.BITS, far, replace=False)
                row[at] = ~row[at]
            pairs, differ = decontaminate.near(items, turned, number)
            own = {w: d for (w, i), d in zip(pairs.tolist(), differ.tolist(), strict=True) if w == i}
            assert own == (dict.fromkeys(range(90), far) if far <= decontaminate.RADIUS else {})


def test_edited_passages_against_all_windows():
    """Recall of the fingerprints, against the similarity of every window of an item's length."""
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 10**6, rng.integers(20, 60)))) for k in range(60)]
    items, found, all_ = decontaminate.prepare(rows), 0, 0
    for k, text in rows:
        for _ in range(6):
            words = text.split()
            words[rng.integers(0, len(words))] = "other"
            column = pa.array([" ".join([*(f"a{x}" for x in rng.integers(0, 10**6, 30)), *words, *(f"b{x}" for x in rng.integers(0, 10**6, 30))])])
            _, value = decontaminate._text_shingles(column)
            best, m = 0.0, len(words) - decontaminate.SHINGLE + 1
            for a in range(len(value) - m + 1):
                own = value[a : a + m]
                bag = {}
                for x, w in zip(own.tolist(), items.weigh(own).tolist(), strict=True):
                    bag[x] = bag.get(x, 0) + w
                best = max(best, decontaminate.similarity(bag, items.bags[k]))
            if best >= decontaminate.THRESHOLD:
                all_ += 1
                found += (0, k) in decontaminate.hits(items, column)
            else:
                assert (0, k) not in decontaminate.hits(items, column)
    assert all_ > 100 and found >= 0.98 * all_


def test_rows_are_judged_by_their_own_text(spark):
    item = " ".join(f"bench{i}" for i in range(30))
    docs = spark.createDataFrame([(1, item, 1), (1, "other words of the same id", 2), (2, None, 3), (3, "", 4)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    assert sorted(r["item_id"] for r in decontaminate.clean(docs, bench, spark).collect()) == [2, 3, 4]
    assert decontaminate.clean(docs.limit(0), bench, spark).columns == docs.columns


def test_letters_decide_und(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out()))
    rows = [(0, "\u00d7 \u060c \u0967"), (1, "\U0001d400\U0001d401"), (2, "\uff76"), (3, "\u2102"), (4, "\U00010330"), (5, "x" * 300_000), (6, "ab " * 60_000)]
    table = spark.createDataFrame([(i, t, "zz", 0.5) for i, t in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in langid.identify(table, model).collect()}
    assert got[0]["lang_pred"] == "und" and all(got[k]["lang_pred"] in model.languages for k in range(1, 7))
    kept = langid.with_language(table, model, 0.5)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} >= {1, 5, 6} and 0 not in {r["doc_id"] for r in kept.collect()}


LONG = "This is a long paragraph of an article that says a number of things about the matter at hand, and goes on for quite a while, as such paragraphs do."
AROUND = "<html><head><title>t</title></head><body><nav><a href=a>Home</a> <a href=b>News</a></nav>{}<footer>Copyright 2026 Site</footer></body></html>"


def test_no_name_and_no_form_empties_a_page():
    body = f"<p>{LONG}<p>{LONG} Again."
    wraps = [
        '<div class="overflow-hidden">{}</div>', '<article class="overflow-hidden">{}</article>', '<div class="side-by-side">{}</div>', '<div class="notice-text">{}</div>', '<div class="story-tags">{}</div>', '<div class="hidden md:block">{}</div>',
        '<div id=search>{}</div>', "<form action=x>{}</form>", '<div class="sidebar">{}</div>', "<fieldset><div>{}</div></fieldset>",
    ]
    for wrap in wraps:
        assert html_mincut.main_text(AROUND.format(wrap.format(body))) == f"{LONG}\n\n{LONG} Again.", wrap
    short = ["It rained.", "He left at nine.", "Nobody came.", "She waited for a long time.", "Then the phone rang."]
    assert html_mincut.main_text(AROUND.format("<div>" + "".join(f"<p>{x}</p>" for x in short) + "</div>")) == "\n\n".join(short)


def test_what_is_beside_the_article_goes():
    many = "".join(f"<p>Great read, I liked it a lot and will come back, number {i}</p>" for i in range(12))
    page = AROUND.format(f'<article><p>{LONG}</p><p>{LONG}</p></article><div class="comments">{many}</div><aside><p>{LONG[:90]}</p></aside><div class="newsletter">{LONG[:80]}</div>')
    assert html_mincut.main_text(page) == f"{LONG}\n\n{LONG}"


def test_short_benchmark_items_are_found_inside_texts(spark):
    items = spark.createDataFrame([(1, "what is the capital"), (2, "What is the capital"), (3, "quartz"), (4, "of France today"), (5, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "He asked: what is the capital of France today?"), (2, "what is the"), (3, "nothing here at all to see"), (4, "Quartz"), (5, "what is the capital"), (6, None), (7, "quartz " * 3)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["start_word"], r["n_words"], r["similarity"]) for r in decontaminate.contaminated(docs, items, spark).collect())
    assert got == [(1, 1, 2, 4, 1.0), (1, 2, 2, 4, 1.0), (1, 4, 6, 3, 1.0), (4, 3, 0, 1, 1.0), (5, 1, 0, 4, 1.0), (5, 2, 0, 4, 1.0), (7, 3, 0, 1, 1.0)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items, spark).collect()) == [2, 3, 6]


def test_line_limit_is_one_rule_for_small_and_large_hosts(spark):
    line = "All rights reserved by the owners of this host"
    letters = str.maketrans("0123456789", "abcdefghij")  # digits of a line count as equal
    text = lambda i, with_line: " ".join(f"{i}x{k}".translate(letters) for k in range(60)) + (f"\n{line}" if with_line else "")
    docs = [(i, "three", text(i, True)) for i in range(3)] + [(100 + i, "sixty", text(100 + i, i < 7)) for i in range(60)] + [(1000 + i, "large", text(1000 + i, i < 700)) for i in range(8000)]
    docs += [(20_000 + i, "wide", text(i, i < 801)) for i in range(8000)]
    got = {r["doc_id"]: r["removed_chars"] for r in line_quality.line_quality(spark.createDataFrame(docs, "doc_id long, source string, text string"), spark).collect()}
    size = len(line.replace(" ", ""))
    assert {got[i] for i in range(3)} == {0}  # fewer than six documents are no template
    assert {got[100 + i] for i in range(7)} == {size} and got[107] == 0  # 7 of 60
    assert {got[1000 + i] for i in range(700)} == {0}  # 700 of 8000 are less than a tenth
    assert {got[20_000 + i] for i in range(801)} == {size}
