"""Each operator beside a plain version, an exact round trip or held-out accuracy."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from railtap.llm import (
    alignment, ann, byte_bpe, chat_format, components, html_labels, html_text, mixing, near_dedup, negatives, packing, quality,
    token_counts, toxicity, url_filter, warc)
from railtap.llm.common import swap_or_not

BPE = tokenizer_path("byte_bpe_50k.json")
PIECES = tokenizer_path("piece_bpe_32k.model")
WS = b" \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# mixing

@pytest.mark.parametrize("n", [1, 2, 7, 100, 256])
def test_swap_or_not_is_a_permutation(spark, n):
    rows = spark.range(n).select(swap_or_not(F.col("id"), F.lit(n), F.lit(5)).alias("y")).collect()
    assert sorted(r["y"] for r in rows) == list(range(n))


def test_targets_share_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 400, "e": 30, None: 700}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), (5, 2, 1), 150, 2).collect()
    names = [*sorted(k for k in sizes if k), None]
    weight, bound = dict(zip(names, [5, 2, 1] * 2)), {k: 2 * v for k, v in sizes.items()}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = (total - sum(bound[k] for k in full)) / sum(weight[k] for k in names if k not in full)
        more = {k for k in names if k not in full and weight[k] * rest > bound[k]}
        if not more:
            break
        full |= more
    for r in rows:
        k = r["source"]
        assert r["target"] == pytest.approx(bound[k] if k in full else weight[k] * rest)


def test_mix_meets_its_targets_and_agrees_when_run_again(docs):
    one = mixing.taken(mixing.mix(mixing.sized(docs), block_words=64)).toPandas()
    two = mixing.taken(mixing.mix(mixing.sized(docs.repartition(5)), block_words=64)).toPandas()
    assert one.sort_values("doc_id").reset_index(drop=True).equals(two.sort_values("doc_id").reset_index(drop=True))
    src = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    for _, g in one.groupby(one.doc_id.map(src)):
        assert g["taken"].sum() == int(g["target"].iloc[0])
    assert (one["taken"] <= 2 * one["size"]).all()


def test_mixed_texts_hold_the_words_taken(docs):
    rows = mixing.mix_documents(docs, block_words=64)
    words = rows.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n"))
    got = {r["doc_id"]: r["n"] for r in words.collect()}
    want = {r["doc_id"]: r["taken"] for r in mixing.taken(mixing.mix(mixing.sized(docs), block_words=64)).collect()}
    assert got == {k: v for k, v in want.items() if v}


# packing and counts

ODD = ["", " ", "a", "a  b", "a   b\n\n c", "x <|endoftext|> y", "it's\tIt'LL 123 4,5\u00a0z", "日本 語 ３ ᾲ", "line\n\n  next \r\n", "\x1c\x1d a\x85b", "  lead", "tail "]


def test_units_give_the_library_ids(texts):
    library, units = Tokenizer.from_file(BPE), byte_bpe.id_units(BPE)
    r = random.Random(1)
    made = ["".join(r.choice(" \n\tab'sé1,.<|") for _ in range(r.randrange(40))) for _ in range(500)]
    for t in [*ODD, *made, *texts.values()]:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(units.values(t)), "<u2").tolist() == want, t[:80]


def test_counts_equal_the_library(spark, docs, texts):
    library = Tokenizer.from_file(BPE)
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    want = texts | {-1 - i: t for i, t in enumerate(ODD)}
    for r in token_counts.count_tokens(docs.select("doc_id", "text").unionAll(odd), BPE).collect():
        assert r["n_tokens"] == len(library.encode(want[r["doc_id"]], add_special_tokens=False).ids)
        assert r["n_bytes"] == len(want[r["doc_id"]].encode())


def test_counts_of_a_sentencepiece_model(docs, texts):
    import sentencepiece
    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in token_counts.count_tokens(docs.limit(20), path).collect():
        assert r["n_tokens"] == len(model.encode(texts[r["doc_id"]]))


def test_packing_places_every_id_once(docs, texts):
    library = Tokenizer.from_file(BPE)
    ids = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    at, windows = Counter(), {}
    for r in sorted(packing.pack(docs, BPE, keep_ids=True).collect(), key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert bytes(r["ids"]) == own.tobytes() and r["ids_crc32"] == zlib.crc32(own.tobytes())
        at[r["doc_id"]] += r["length"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(at[k] == len(v) for k, v in ids.items())
    padding = 0
    for places in windows.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding <= 0.01 * sum(at.values())


@pytest.mark.parametrize("lengths", [[2047] * 50, [1] * 5000, [1024] * 33, list(range(1, 2048)), [700, 700, 648] * 40])
def test_layouts(lengths):
    count = Counter(lengths)
    layout, windows = packing.plan(count), {}
    for n, times in count.items():
        for rank in range(times):
            places = [(*layout.used_place(n, rank), n)] if rank < layout.used[n] else list(layout.residual_places(n, rank))
            assert sum(p[2] for p in places) == n
            for s, o, k in places:
                windows.setdefault(s, []).append((o, k))
    for s, places in windows.items():
        end = 0
        for o, k in sorted(places):
            assert o == end
            end += k
        assert end <= 2048 and s < layout.sequences


# pages

def test_tree_fits_its_table_and_holds_out():
    tree = html_text.trained()
    for page in html_labels.pages():
        assert [tree.of(f) for f in html_text.features(html_text.blocks(page.html))] == page.labels(html_text.blocks)


PAGE = ("<html><head><title>no</title></head><body><header>Top</header><nav><a href=x>Menu</a></nav><div class='cookie-notice'>We use cookies</div>"
        "<main><h1>T &amp; &#85;</h1><p>one\n <b>two</b>&nbsp;three<br>four</p><!-- <p>no</p> --><script>if (a < b) '</p>'</script>"
        "<div class=ad>buy</div><ul><li>x<li>y</ul><form><input><label>mail</label></form></main>"
        "<aside>side</aside><section id='comments'><article><p>" + "I like it " * 30 + "</p></article></section><footer>end</footer>")


def test_extract_by_hand(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", "<p>")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    text = "T & U\none two three four\nx\ny"
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0)}


@pytest.mark.parametrize("before", [
    '<body class="single has-sidebar">', '<body><div class="content no-sidebar">', '<body class="header-fixed">', '<body><div id="search-page"><main>',
    '<body><article class="post comment-open">', "<head><title>no</title><body>"])
def test_names_of_wrappers_do_not_drop_the_page(before):
    text = "The river rose in the night and by morning the lower meadow was under water, so the farmers moved the herd to the hill. " * 3
    page = f"<html>{before}<nav><a href=x>Menu</a></nav><p>{text}</p><p>{text}</p><div class='ad'>Buy boots now.</div><footer>end</footer>"
    assert html_text.main_text(page, html_text.trained()).split("\n") == [text.strip()] * 2


# conversations

EVENTS = [(1, "m1", 1, None, "user", "hel"), (1, "m1", 2, "delta", "user", "lo"), (1, "m2", 3, "delta", "assistant", "first"),
          (1, "m3", 4, "delta", "user", "more"), (1, "m2", 5, "regenerate", "assistant", None), (1, "m2", 6, "delta", "assistant", "sec"),
          (1, "m2", 7, "delta", "assistant", "ond"), (1, "m4", 8, "delta", "user", "bad"), (1, "m4", 9, "edit", "user", "good"),
          (1, "m4", 10, "delta", "user", "!"), (2, "m1", 1, "delta", None, None)]


def test_events_fold(spark):
    events = spark.createDataFrame(EVENTS, "conv_id long, message string, seq long, kind string, role string, text string")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat_format.conversations(chat_format.messages(events)).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "second"), ("user", "good!")], 2: [("", "")]}


def test_any_text_comes_back(spark):
    r = random.Random(2)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "s>", "\n", "$1", "é", " ", "/"]
    said = [[("assistant" if j % 2 else "user\n<s>", "".join(r.choice(bits) for _ in range(r.randrange(12)))) for j in range(4)] for _ in range(60)]
    rows = [(i, j, *t) for i, c in enumerate(said) for j, t in enumerate(c)] + [(99, None, "b", ""), (99, None, "a", None), (99, 0, None, "z"), (99, 0, None, "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parsed = chat_format.parse(chat_format.format_turns(table))
    got = {x["conv_id"]: x for x in parsed.collect()}
    for i, c in enumerate(said):
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == c
    assert [(t["role"], t["text"]) for t in got[99]["turns"]] == [("a", ""), ("b", ""), ("", "z"), ("", "z")]
    one = {x["conv_id"]: x for x in chat_format.digests(parsed).collect()}[0]
    learned = "".join(t for role, t in said[0] if role == "assistant")
    assert (one["loss_chars"], one["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert one["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said[0]).encode()).hexdigest()


# quality

def _measures(text):
    words = text.encode().split()
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often, inside = Counter(wins), set()
    for i, w in enumerate(wins):
        if often[w] > 1:
            inside.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(line.encode().split())
        seen.add(line)
    return len(words), len(text) - sum(text.count(chr(c)) for c in WS), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_measures_and_verdicts(spark, docs, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    for k, t in texts.items():
        r = rows[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == _measures(t)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
    assert sorted(r["doc_id"] for r in quality.keep(docs, labels).collect()) == sorted(k for k, r in rows.items() if r["kept"])


def test_held_out_labels(spark):
    """On the next larger tables: the smallest have three rejected documents in the held-out half."""
    docs, labels = (spark.read.parquet(f"{os.path.dirname(SF)}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed").collect()
    good, bad = [r["kept"] for r in rows if r["quality"]], [r["kept"] for r in rows if not r["quality"]]
    assert np.mean(good) > 0.97 and np.mean(bad or [0]) < 0.2


# near duplicates

def _groups(sets):
    ids, root = sorted(sets), {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_groups_equal_all_pairs(docs, texts, size):
    sets = {}
    for k, t in texts.items():
        w = t.encode().lower().split()
        n = min(size, len(w))
        sets[k] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
    want = _groups(sets)
    for r in near_dedup.find(docs, size=size).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_copies_across_task_edges(spark):
    """A large group of near copies, cut by many partition edges, stays one."""
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([*words[:k % 100], f"new{k}", *words[k % 100 + 1:]])) for k in range(3000)]
    got = near_dedup.find(spark.createDataFrame(rows, "doc_id long, text string"), size=2).select("component_id").distinct().collect()
    assert [r["component_id"] for r in got] == [0]


@pytest.mark.parametrize("base", [0.71, 0.785])
def test_pairs_in_a_crowd_of_one_template(spark, base):
    """Documents of one template, alike below the limit, and among them pairs at 0.8 and a little more."""
    r, n, m = np.random.default_rng(int(1000 * base)), 400, 500
    same = round(2 * base / (1 + base) * n)
    need, texts = -(-80 * 2 * n // 180), []
    for k in range(m):
        texts.append([f"t{i}" for i in range(same)] + [f"u{k}x{i}" for i in range(n - same)])
        if k % 5 == 0:  # a partner that has just as many of its words as the limit asks for
            texts.append(texts[-1][:need + k % 3] + [f"v{k}x{i}" for i in range(n - need - k % 3)])
    order = r.permutation(len(texts))
    rows = [(int(i), " ".join(r.permutation(texts[j]))) for i, j in enumerate(order)]
    want = _groups({i: set(t.split()) for i, t in rows})
    assert len(set(want.values())) == m
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.find(spark.createDataFrame(rows, "doc_id long, text string"), size=1).collect()}
    assert got == want


def test_components_of_a_long_path(spark):
    links = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).unionAll(
        spark.range(301, 320).select(F.lit(300).cast("long"), F.col("id")))
    got = {r["u"]: r["v"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(1, 200)} | {i: 300 for i in range(301, 320)}


# Pages whose parts are not named as the labelled table names them, or that are wrapped or broken.
_P = "The river rose in the night and by morning the lower meadow was under water, so the farmers moved the herd to the hill."
_Q = "We walked along the coast for two days and saw nobody but a man with a dog who asked us for the time of the ferry."
ODD_PAGES = {
    "comments larger than the article": (f'<body><div><p>{_P}</p><p>{_P}</p></div><div class="comments">{f"<p>{_Q}</p>" * 5}</div>', f"{_P}\n{_P}"),
    "comment list": (f'<h1>T</h1><p>{_P}</p><ol class="commentlist"><li>{_Q}</li><li>{_Q}</li></ol>', f"T\n{_P}"),
    "discussion": (f'<p>{_P}</p><div id="discussion"><p>{_Q}</p></div>', _P),
    "comments in the article": (f'<article><h1>T</h1><p>{_P}</p><div class="comments"><p>{_Q}</p><p>{_Q}</p></div></article>', f"T\n{_P}"),
    "form around the page": (f'<body><form id="aspnet"><div><h1>Tall water</h1><p>{_P}</p><p>{_P}</p></div></form></body>', f"Tall water\n{_P}\n{_P}"),
    "nav never closed": (f'<body><nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><h1>Tall water</h1><p>{_P}</p><p>{_P}</p>', f"Tall water\n{_P}\n{_P}"),
    "nav never closed before an article": (f"<nav><ul><li><a href=1>Home</a></li></ul><article><h1>Tall water</h1><p>{_P}</p></article>", f"Tall water\n{_P}"),
    "short paragraphs": (f"<h1>T one</h1><p>{_P}</p><p>Nobody answered.</p><p>{_P}</p>", f"T one\n{_P}\nNobody answered.\n{_P}"),
    "title in the article's header": (f"<article><header><h1>Tall water</h1></header><p>{_P}</p></article>", f"Tall water\n{_P}"),
    "links inside an article": ("<article><h1>Tall water</h1><p>" + _P + "</p><ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(30))
                                + f'</ul><p>{_P}</p><p><a href="/">Home</a> / <a href="/n">News</a></p></article>', f"Tall water\n{_P}\n{_P}"),
    "other names of adverts and sidebars": (f'<article><p>{_P}</p><div class="adbox">Buy boots now.</div></article><div class="rightcol"><p>{_Q}</p></div>', _P),
    "character data": (f"<article><p><![CDATA[x < y & {_P}]]></p></article>", f"x < y & {_P}"),
    "classes of wrappers": (f'<body class="single has-sidebar comments-open"><div class="content no-sidebar"><p>{_P}</p><p>{_P}</p></div></body>', f"{_P}\n{_P}"),
    "a site's header": (f'<div class="header"><h1>The Post</h1><p>All the news</p></div><div><p>{_P}</p><p>{_P}</p></div><div class="footer">About us</div>', f"{_P}\n{_P}"),
    "copyright line in an article": (f"<article><p>{_P}</p><p>Copyright 2019 by the author</p></article>", f"{_P}\nCopyright 2019 by the author"),
    "very long": (f"<article>{f'<p>{_P}</p>' * 5_000}</article>", "\n".join([_P] * 5_000)),
}


@pytest.mark.parametrize("name", ODD_PAGES)
def test_odd_pages(name):
    page, want = ODD_PAGES[name]
    assert html_text.main_text(page, html_text.trained()) == want


def test_link_density_decides_in_the_tree():
    used, todo = set(), [html_text.trained()]
    while todo:
        node = todo.pop()
        if node.left is not None:
            used.add(node.feature)
            todo += [node.left, node.right]
    assert 9 in used   # the block's own link density
    linked = '<article><p>{}</p><p>{}</p></article>'.format(_P, "".join(f'<a href="/{w}">{w}</a> ' for w in _Q.split()))
    assert html_text.main_text(linked, html_text.trained()) == _P


def test_page_columns_of_any_name(spark):
    rows = [(1, "u", f"<article><p>{_P}</p></article>", "c"), (1, "u", f"<article><p>{_P}</p></article>", "c"), (None, None, None, None), (2, "", "", "")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, _P, len(_P)), (1, _P, len(_P)), (2, "", 0)]


# URLs

URLS = ["HTTP://A.Example.NET/en/x?q#f", "https://example.com/de/1", "https://www.cheap-pills.example.com/fr/1", "http://x.org/fr/", "x.org/fr/",
        None, "", "http://net/", "http://anet/x", "a://b://c/d", "https://ÀB.com?x/y", "http://thonre.example.com/en/7", "http://best-casino.example.com"]


def test_rules_and_parts(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    table = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    for r in url_filter.judge(table, rules).collect():
        url = URLS[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(t), said, t) for said, t in rules for h, p in [t.split("/", 1)]
               if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fit)[2] if fit else None)
        if fit:
            assert r["verdict"] == max(fit)[1]
    got = {r["url"]: r["verdict"] for r in url_filter.judge(table, []).collect()}
    assert got[URLS[2]] == got[URLS[12]] == "block" and got[URLS[11]] == got[None] == got["x.org/fr/"] == "allow"


# Sites of words that the labelled table does not hold.
ORDINARY_URLS = """https://www.lemonde.fr/politique/ https://www.gov.uk/browse/benefits https://stackoverflow.com/questions/1
https://www.zeit.de/kultur/index https://en.wikipedia.org/wiki/Otter https://www.elpais.com/ http://www.corriere.it/cronache
https://www.bbc.co.uk/sport https://www.mit.edu/ https://arxiv.org/abs/1706.03762 https://www.spiegel.de/ausland https://github.com/apache/spark
https://www.nasa.gov/missions https://www.deutschlandfunk.de/ https://www.louvre.fr/en https://www.debian.org/distrib/ https://www.who.int/teams
https://www.vogelschutz-sachsen.de/termine https://www.fahrradwerkstatt-nord.de/ https://www.violinmaker-hansen.dk/ http://www.pottery-lessons.ie/
https://www.tierheim-ulm.de/katzen https://www.boulangerie-martin.fr/horaires https://www.ferreteria-lopez.es/ https://www.quaker.org/meeting
https://pediatrics-riverside.com/appointments https://www.knitting-patterns.net/scarf https://www.sternwarte-bonn.de/ https://www.allotment.org.uk/soil
https://www.beekeepers.ca/honey https://www.lighthouse-trust.org/visit https://www.bookbinding.com/tools https://www.hiking-alps.at/huts
https://www.plumber-leeds.co.uk/ https://www.orchestra-lyon.fr/concerts https://www.vineyard-rioja.es/bodega""".split()
UNWANTED_URLS = """http://onlinecasinos24.com/ http://www.pokerstarz.net/play http://sportbetting-king.com/ http://megaslotmachine.xyz/spin
http://jackpotcity-bonus.top/ http://www.gamblers-den.biz/ http://bingohall.club/ http://lottoland-win.info/ http://sportwetten-bonus.de/
http://casinogratis.es/ http://roulettewheel.ru/ http://pokies-gamblingsite.com/ http://www.buyviagraonline.com/ http://pillstore-rx.net/
http://genericcialis.info/ http://xanaxbars.pw/ http://steroidshop.biz/ http://www.freepornvideos.tv/ http://xxxmovies.to/ http://sexchatroom.com/
http://escortgirls-berlin.de/ http://hentaiworld.net/ http://nudecams.live/ http://hotmilfs.com/ http://fetishclips.net/ http://hookupsite.dating/
http://quickpaydayloans.com/ http://forextradersignals.biz/ http://cryptoprofiteer.io/ http://bitcoindoubler.top/ http://replicawatches.cn/
http://fakerolexes.ru/ http://spammers-list.com/ http://warezcentral.to/ http://keygenerator-crackz.net/ http://torrentz.cc/""".split()


def test_model_holds_out(spark):
    """Held-out accuracy of 0.85 or more on sites that share no word with the labelled table."""
    import re
    words = lambda urls: {w for u in urls for w in re.findall("[a-z]{4,}", u.lower())} - {"https", "http", "info", "site", "world"}
    table = [u for u, _ in url_filter.labelled_urls()]
    named = words([u.split("://")[1].split("/")[0] for u in ORDINARY_URLS + UNWANTED_URLS])
    known = set(url_filter.UNWANTED + url_filter.ORDINARY)
    shared = named & known
    assert not shared, shared
    rows = spark.createDataFrame([(u,) for u in ORDINARY_URLS + UNWANTED_URLS], "url string")
    got = {r["url"]: r["verdict"] for r in url_filter.judge(rows, []).collect()}
    right = sum(got[u] == "allow" for u in ORDINARY_URLS) + sum(got[u] == "block" for u in UNWANTED_URLS)
    assert right >= 0.85 * (len(ORDINARY_URLS) + len(UNWANTED_URLS)), (
        [u for u in ORDINARY_URLS if got[u] != "allow"], [u for u in UNWANTED_URLS if got[u] != "block"])


def test_label_table_does_not_hold_the_sites_of_the_pages(spark):
    urls = spark.read.parquet(f"{SF}/pages.parquet").select(*url_filter.host_and_path(F.col("url"))).toDF("host", "path")
    sites = {x for r in urls.distinct().collect() for x in r["host"].split(".") if len(x) > 4 and x not in ("example", "online")}
    labelled = {x for u, _ in url_filter.labelled_urls() for x in u.split("://")[1].split("/")[0].split(".")}
    assert sites and not sites & labelled


def test_url_columns_of_any_name(spark):
    rows = [(1, "http://a.net/x", "c"), (1, "http://a.net/x", "c"), (2, "http://" + "long" * 20_000 + ".org/" + "p" * 50_000, "c"), (3, None, "c"), (4, "", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, _features string")
    for c in ("_raw", "_probability", "_blocked", "grams", "rule", "host", "_row"):
        df = df.withColumn(c, F.lit("clash"))
    got = url_filter.judge(df, [("block", "net/")])
    assert got.count() == 5 and {"_features", "grams", "_row", "_blocked"} <= set(got.columns)
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in got.collect()} >= {(1, "net/", "block"), (3, None, "allow"), (4, None, "allow")}


# archives

def test_archive_round_trip(spark, tmp_path):
    rows = [(3, "u3", "same"), (1, "u\r\n1", "same"), (2, None, None), (4, "é", ""), (5, "x", "big" * 100_000), (None, "n", "same"), (6, "y", "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    path = warc.write_pages(pages, str(tmp_path / "all"))
    got = {r["page_id"]: tuple(r)[1:] for r in warc.read_back(spark, path).collect()}
    import base64
    sha = {k: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for k, _, h in rows}
    size = {k: len((h or "").encode()) for k, _, h in rows}
    first = {1: 1, 3: 1, None: 1, 2: 2, 4: 2, 5: 5, 6: 6}
    assert got == {k: (size[k], sha[k], *(("response", None) if first[k] == k else ("revisit", first[k]))) for k in size}
    heads = spark.read.format("warc").schema("record_id string, uri string").load(path)
    assert heads.filter("uri = 'u\r\n1'").collect()[0]["record_id"] == "urn:page:1"
    all_kept = warc.read_back(spark, warc.write_pages(pages, str(tmp_path / "large"), least_bytes=10))
    assert {r["record_type"] for r in all_kept.collect()} == {"response"}


def test_other_archives(spark, tmp_path):
    import gzip
    one = warc.record("resource", "urn:a", {"WARC-Target-URI": "u"}, b"x" * 200_000)
    two = warc.record("metadata", "urn:b", {}, b"")
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    warc.register(spark)
    rows = spark.read.format("warc").load(str(tmp_path)).collect()
    assert sorted((r["record_id"], len(r["payload"])) for r in rows) == [("urn:a", 200_000)] * 2 + [("urn:b", 0)] * 2
    some = spark.read.format("warc").load(str(tmp_path)).filter("record_type = 'metadata'").select("record_id").collect()
    assert [r["record_id"] for r in some] == ["urn:b"] * 2


# neighbours

def test_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got, hit, want = {}, 0, 0
    for r in ann.search(table, "vec_id % 20 = 0").collect():
        got.setdefault(r["query_id"], []).append(r)
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        mine = sorted(got[ids[i]], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(best) + 1))
        hit, want = hit + len({r["vec_id"] for r in mine} & set(ids[best])), want + len(best)
        for r in mine:
            assert r["score"] == pytest.approx(score[np.searchsorted(ids, r["vec_id"])], abs=1e-12)
    assert hit >= 0.9 * want


def test_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 2.0, -1.0]) for i in range(60)] + [(100, None), (120, []), (140, [0.0, 0.0, 0.0]), (160, [1.0, None, 2.0]),
                                                       (180, [float("nan"), 1.0, 1.0]), (200, [float("inf"), 0.0, 0.0]), (220, [1.0, 2.0]), (None, [2.0, 4.0, -2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rid", F.lit("clash"))
    got = ann.search(table, "vec_id % 20 = 0").collect()
    assert {r["query_id"] for r in got} == {0, 20, 40}
    mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 20)
    assert mine[0][1:] == (None, 12.0)
    assert [m[1] for m in mine[1:]] == [i for i in range(60) if i != 20][:19]


# toxicity

@pytest.fixture(scope="module")
def toxic_model(docs, spark):
    """Fitted on clean texts and the same kind of texts with a few marked words among theirs."""
    rng = random.Random(2)
    words = "the river rose in night and by morning lower meadow was under water so farmers moved their herd up to old barn near mill where".split()
    marked = ["idiot", "moron", "worthless", "pathetic", "stupid", "scum"]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(60)]
        if i % 3 == 0:
            for w in rng.sample(marked, 2):
                text.insert(rng.randrange(60), w)
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return rows, labels, toxicity.fit(d.unionByName(docs.select("doc_id", "text").withColumn("doc_id", F.lit(-1).cast("long"))),
                                      spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxicity_holds_out(spark, toxic_model):
    rows, labels, model = toxic_model
    truth = dict(labels)
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    out = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) >= 0.98 * len(out)


@pytest.mark.parametrize("disguise", [
    lambda w: w.replace("o", "0").replace("i", "1").replace("s", "$"), " ".join, ".".join, "-".join,
    lambda w: w[:2] + w[1] * 3 + w[2:], str.upper, lambda w: f'"{w}!!"'])
def test_disguised_words_are_found(spark, toxic_model, disguise):
    rows, labels, model = toxic_model
    clean = [t for (i, t), (_, y) in zip(rows, labels) if not y][:100]
    hidden = [f"{t} {disguise('moron')} {t[:50]} {disguise('stupid')} {disguise('scum')}" for t in clean]
    got = toxicity.score(spark.createDataFrame(list(enumerate(hidden)), "doc_id long, text string"), model).collect()
    assert sum(r["predicted"] for r in got) >= 95


def test_labels_of_the_held_out_part_are_never_read(docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = ({(r["doc_id"], r["score"]) for r in toxicity.judge(docs, x).collect()} for x in (labels, turned))
    assert one == other


def plain_reading(costs, span):
    """Cheapest reading of a span by trying every path."""
    best = []

    def walk(i, context, cost, out, before):
        if i == len(span):
            best.append((cost + (costs[context << 5] if context & 31 else 0.0), out))
            return
        c = span[i]
        of = toxicity.code(c)
        options = [(c, of, 0.0)] if of else [(" ", 0, 0.0)] + (
            [(x, toxicity.code(x), toxicity.LOOKALIKE) for x in toxicity.LOOKALIKES[c]] if c in toxicity.LOOKALIKES else [("", None, toxicity.GAP)])
        if c == before and not c.isspace():
            options.append(("", None, toxicity.REPEAT))
        for text, code, more in options:
            if code or code == 0 and context & 31:
                run = context << 5 | code
                walk(i + 1, run & 0x7FFF, cost + more + costs[run], out + text, c)
            else:
                walk(i + 1, context, cost + more, out, c)

    walk(0, 0, 0.0, "", "")
    return min(b[0] for b in best), best


def test_viterbi_path_is_the_cheapest(toxic_model):
    costs = toxic_model[2].costs
    decoder, rng = toxicity.Decoder(costs), random.Random(6)
    for _ in range(150):
        span = "".join(rng.choice("idt1o0t s.$a!") for _ in range(rng.randint(1, 8)))
        cheapest, every = plain_reading(costs, span)
        assert decoder.read(span) in {out for cost, out in every if cost <= cheapest + 1e-4}


def test_tokens_are_read_by_stretches(toxic_model):
    costs, rng = toxic_model[2].costs, random.Random(7)
    decoder = toxicity.Decoder(costs)
    for signs in ("idtnno", "idtno1.$", "abo\u00df\u00e9\u00b2-\u0436\u4e2d\U0001d7d8"):
        for _ in range(1500):
            token = "".join(rng.choice(signs) for _ in range(rng.randint(1, 24)))
            assert decoder.read_token(token) == decoder.read(token)
    assert all(bool(re.fullmatch(toxicity._LETTER, chr(i))) == bool(toxicity.code(chr(i))) for i in range(1 << 16) if not 0xD800 <= i < 0xE000)


def test_a_stretch_is_searched_once_for_all_tokens(toxic_model, monkeypatch):
    decoder, spans, read = toxicity.Decoder(toxic_model[2].costs), [], toxicity.Decoder.read
    monkeypatch.setattr(toxicity.Decoder, "read", lambda self, span, *more: spans.append(span) or read(self, span, *more))
    tokens = [f"{a}{b}orninnghed{c}" for a in "bcdfg" for b in "aeiu" for c in "klmnprst"]
    want = [["".join(read(decoder, t))] for t in tokens]
    assert decoder.words_of([*tokens, "plain", "", "a.b"])[:-3] == want
    assert spans == ["nnghe", ".b"]


def test_tokens_of_a_batch(toxic_model):
    texts = ["a b", None, "", " \u2003x  y\nz ", "A\u00a0b\x1cc d", "a", "b", "c", "ab c d\u3000e f", "no"]
    tokens = toxicity.Tokens(texts)
    assert [[t for c in codes if (t := tokens.own[c])] for codes in tokens.each()] == [(t or "").lower().split() for t in texts]
    assert tokens.spaced() == [3, 4, 8]
    assert tokens.places(np.array([tokens.own.index("c")]))[0] == [4, 7, 8]


def test_character_counts_cover_all_texts(spark):
    texts = ["Ab, ab", "é1z", None, "", "ab\nAB"]
    got = {r["run"]: r["n"] for r in toxicity.character_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).collect()}
    want = Counter()
    for t in [t for t in texts if t]:
        codes = [0]
        for c in t.lower() + " ":
            k = toxicity.code(c)
            if k or codes[-1]:
                codes.append(k)
        want.update(codes[i] << 15 | codes[i + 1] << 10 | codes[i + 2] << 5 | codes[i + 3] for i in range(len(codes) - 3))
    assert got == want


# hard negatives

def test_negatives_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(600, 12)))
    x[100:160] = x[100]   # many equal rows
    label = rng.integers(0, 4, 600)
    rows = [(i, int(label[i]), [float(v) for v in x[i]]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, label long, x array<double>").repartition(5)
    got = sorted(tuple(r) for r in negatives.mine(df, "vec_id % 20 = 0").collect())
    want = []
    for a in range(0, 600, 20):
        s = (x @ x[a]).astype(int)
        order = sorted((i for i in range(600) if i != a), key=lambda i: (-s[i], i))
        for p in [i for i in order if label[i] == label[a]][:5]:
            hits = [i for i in order if label[i] != label[a] and 50 * s[p] <= 100 * s[i] <= 95 * s[p]][:3]
            want += [(a, p, r, n, int(s[p]), int(s[n])) for r, n in enumerate(hits, start=1)]
    assert got == sorted(want) and len(want) > 200


def test_shards_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), [float(v) for v in np.floor(50 * rng.normal(size=6))]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label long, x array<double>")
    whole = sorted(tuple(r) for r in negatives.mine(df, "vec_id % 10 = 0").collect())
    monkeypatch.setattr(negatives, "SHARD_ROWS", 23)
    assert sorted(tuple(r) for r in negatives.mine(df, "vec_id % 10 = 0").collect()) == whole


def test_large_components_stay_exact(spark):
    big = float(1 << 60)
    df = spark.createDataFrame([(50, 1, [big, 3.0]), (1, 1, [8.0, 1.0]), (2, 2, [4.0, 2.0]), (3, 2, [4.0, 1.0]), (4, 1, [big, 0.0])],
                               "vec_id long, label long, x array<double>")
    got = sorted(tuple(r) for r in negatives.mine(df, "vec_id = 50").collect())
    most = (1 << 63) - 1   # 2^120 and 2^63 are set to the largest number
    assert (50, 1, 1, 2, most, (1 << 62) + 6) in got and (50, 1, 2, 3, most, (1 << 62) + 3) in got


def test_packed_keys_sort_as_their_parts(spark):
    rng = random.Random(9)
    parts = [(rng.randrange(3), rng.choice([-(1 << 63), -5, 0, 7, (1 << 63) - 1]), rng.randrange(2), rng.choice([None, -9, 0, 4]), rng.randrange(5)) for _ in range(300)]
    by_key = sorted(parts, key=lambda p: negatives.pack(*p))
    assert by_key == sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3] is None, p[3] or 0, p[4]))
    assert all(negatives.unpack(negatives.pack(*p)) == (*p[:3], p[3]) for p in parts)


# token alignment

def plain_alignment(texts):
    """Tokens of both libraries over whole texts, cut at every shared end."""
    import sentencepiece
    a_lib = Tokenizer.from_file(BPE)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = byte_bpe._byte_letters()
    of_a = {i: bytes(letters[c] for c in t) for t, i in a_lib.get_vocab().items() if all(c in letters for c in t)}
    piece = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    rows = []
    for text in texts:
        raw = b" " + (text or "").encode()
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        if not text or b"".join(of_a[i] for i in a) != raw or b"".join(map(piece, b)) != raw:
            rows.append(None)
            continue
        ends = [np.cumsum([len(t) for t in ts]) for ts in ([of_a[i] for i in a], list(map(piece, b)))]
        cuts = np.intersect1d(*ends)
        place = [np.searchsorted(cuts, e) for e in ends]
        spelled = ";".join("|".join(",".join(str(i) for i, p in zip(ids, at) if p == g) for ids, at in ((a, place[0]), (b, place[1]))) for g in range(len(cuts)))
        pairs, starts = [], [np.concatenate([[0], e[:-1]]) for e in ends]
        for i in range(len(a)):
            for j in np.flatnonzero((starts[1] < ends[0][i]) & (ends[1] > starts[0][i])):
                pairs.append((a[i], b[j]))
        rows.append((len(a), len(b), len(cuts), pairs, hashlib.sha256(spelled.encode()).hexdigest()))
    count = Counter(p for r in rows if r for p in r[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(0,) * 6 + ("",) if r is None else (*r[:3], len(r[3]), sum(count[p] == best[p[1]] for p in r[3]), sum(count[p] for p in r[3]), r[4]) for r in rows]


@pytest.mark.parametrize("hot", [0, 40, 1 << 17])
def test_alignment_against_whole_texts(spark, texts, hot):
    rng = random.Random(4)
    odd = ["a", "b", " ", " ", "\n", "é", "日本", "x", "the", "ing", " ", "<|endoftext|>", "</s>", "1", "23", "'s", "\t", "ﬁ", "😀", "​", ".", "!!", "  "]
    some = [None, "", "  ", " ", "a  b", "▁", "x ▁y", *texts.values()]
    some += ["".join(rng.choice(odd) for _ in range(rng.randint(1, 25))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.compare(df, BPE, PIECES, hot).collect()}
    assert [got[i] for i in range(len(some))] == plain_alignment(some)


def test_groups_are_cut_at_every_shared_end():
    rng = random.Random(1)
    for _ in range(500):
        last = rng.randint(1, 60)
        a, b = (sorted({*(rng.randint(1, last) for _ in range(rng.randint(0, 25))), last}) for _ in range(2))
        found = alignment.groups(a, b)
        assert [a[a1 - 1] for _, a1, _, _ in found] == [b[b1 - 1] for *_, b1 in found] == sorted(set(a) & set(b))
        assert [x for g in found for x in range(g[0], g[1])] == list(range(len(a)))
