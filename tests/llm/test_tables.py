"""Reply trees, URL verdicts, components and the pipeline against plain versions."""

import random
from collections import defaultdict

import plain
import pytest
from conftest import sentence

import corpus_pipeline
from fairtender.llm import chat, queries, urls
from fairtender.llm.components import components


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2300)] + [(5, 5)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == want


# reply trees


def test_conversations(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    control = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", control), (-1, 1, "assistant", control)]
    by = defaultdict(list)
    for c, *rest in rows:
        by[c].append(tuple(rest))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op3_reply_trees(spark, sf).collect()}
    assert got == {c: plain.turns_digest(own) for c, own in by.items()}


NASTY = ["", "\\", "\\\\", "a\\", "<s>", "</s", "<", "[INST", "[\\INST] x", "<s>[INST] user [/INST]hi</s>", "\\</s>\\", "<<SYS>>\n", "é🎈</s>", "<|im_end|>", None]


def test_awkward_conversations(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "[/INST]", ""]), rng.choice(NASTY)) for c in [*range(40), None] for t in [*range(6), 3, None]]
    rows += [(100, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(700)]
    by = defaultdict(list)
    for c, *rest in rows:
        by[c].append(tuple(rest))
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, node string, depth string").repartition(5)
    messages = chat.chain(frame)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.conversations(messages)).collect()}
    assert got == {c: plain.turns_digest(own) for c, own in by.items()}
    assert chat.conversations(chat.chain(frame.limit(0))).count() == 0


@pytest.mark.parametrize("text", [t for t in NASTY if t is not None])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_reply_trees(spark):
    rng = random.Random(3)
    rows = []
    for tree in range(12):
        for node in range(rng.randrange(1, 30)):
            rows.append((tree, node, rng.randrange(node) if node else None, "user", f"{tree}.{node}", rng.choice([None, 0.0, 1.0, 2.0])))
    rows += [(50, 1, 2, "user", "cycle", 1.0), (50, 2, 1, "user", "cycle", 1.0), (50, 3, 1, "user", "below", 1.0), (50, 4, 99, "user", "orphan", 1.0)]
    want = set()
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in own.values()}
        ranked = []
        for leaf in sorted(n for n in own if n not in parents):
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][2]
            if at in path:
                continue
            ranked.append((-sum(own[n][5] or 0.0 for n in path) / len(path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(ranked)[:2], 1):
            want.add((tree, leaf, rank, tuple(path)))
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    paths = defaultdict(list)
    for r in chat.branches(frame, top=2).collect():
        paths[r.tree, r.leaf, r.rank].append((r.depth, r.node))
    got = {(*k, tuple(n for _, n in sorted(v))) for k, v in paths.items()}
    assert got == want
    told = {(r.tree, r.rank): [t for _, t in chat.read_turns(r.text)] for r in chat.conversations(frame, top=2).collect()}
    assert told == {(t, k): [f"{t}.{n}" for n in path] if t < 50 else ["orphan"] for t, _, k, path in want}


# urls


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = plain.lower(rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = (None, None)
    for verdict, rule in queries.URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return host, path, *best


def test_url_verdicts(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op8_url_verdicts(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        host, path, rule, verdict = plain_rule(p.url)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or "allow")


def test_url_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.test/1", link.format("https://X.net/b")),  # points at a blocked address
        (2, "http://a.test/2", "<META HTTP-EQUIV='refresh' content='0; url=http://a.test/1?q=1&amp;r=2'>"),
        (3, "http://a.test/1?q=1&r=2#top", "<link href=//c.test/3 rel=canonical>"),
        (4, "https://c.test/3", link.format("/4")),
        (5, "http://c.test/4", None),
        (6, "http://d.org/fr/", link.format("http://e.test/")),
        (7, "http://e.test", link.format("http://www.y.net/")),
        (8, "http://www.y.net/", ""),
        (9, "http://f.test/", link.format("mailto:a@b.test")),
        (10, None, link.format("http://y.net/")), (11, "no address", link.format("http://y.net/")), (12, "", ""), (13, "HTTP://A.TEST/1?x#y", ""),
        (14, "http://g.test/1", "<link rel=stylesheet href=http://y.net/><a href='http://y.net/'>canonical</a>"),
        (1, "http://a.test/1", link.format("https://X.net/b")),
    ]
    frame = spark.createDataFrame([(*p, "h", "q") for p in pages], "page_id long, url string, html string, host string, rule string")
    extra = spark.createDataFrame([("c.test/4", "z.test/"), ("c.test/3", "a.test/2")], "a string, b string")
    rows = urls.judge(frame, queries.URL_RULES, edges=extra).collect()
    got = {r.page_id: (r.verdict, r.via) for r in rows}
    assert len(rows) == len(pages)
    for p in pages:
        assert (*[(r.host, r.path, r.rule) for r in rows if r.page_id == p[0]][0],) == plain_rule(p[1])[:3]
    assert got[1] == ("block", "alias")
    # 2, 3, 4, 5 form another class, without a rule
    assert {got[i] for i in (2, 3, 4, 5)} == {("allow", "alias")} or {got[i] for i in (2, 3, 4, 5)} == {("allow", "default")}
    assert got[6] == ("allow", "rule") and got[7] == ("allow", "alias") and got[8] == ("block", "rule")
    assert got[9] == ("allow", "default") and {got[i] for i in (10, 11, 12, 13, 14)} == {("allow", "default")}
    assert urls.judge(frame.limit(0), queries.URL_RULES).count() == 0


def test_relative_targets(spark):
    link = '<link rel="canonical" href="{}">'
    forms = {
        "page.html": "h.test/a/b/page.html", "./page.html": "h.test/a/b/page.html", "../x": "h.test/a/x", "../../x?y=/../z": "h.test/x?y=/../z", "../../../x": "h.test/x", "..": "h.test/a/", ".": "h.test/a/b/",
        "?p=1": "h.test/a/b/c?p=1", "/d/../e": "h.test/e", "/d": "h.test/d", "//Other.test/f": "other.test/f", "https://o.test": "o.test/", "d//e": "h.test/a/b/d//e", "r?to=http://x.test/": "h.test/a/b/r?to=http://x.test/",
        "#top": None, "": None, "mailto:a@b.test": None, "javascript:x": None,
    }
    pages = spark.createDataFrame([(i, "http://H.test/a/b/c?q=1#f", link.format(t)) for i, t in enumerate(forms)], "page_id long, url string, html string")
    got = sorted((r.a, r.b) for r in urls.link_edges(pages).collect())
    assert got == sorted(("h.test/a/b/c?q=1", b) for b in forms.values() if b)
    bare = spark.createDataFrame([(1, "http://h.test", link.format("x")), (2, "http://h.test?q", link.format("?r"))], "page_id long, url string, html string")
    assert {(r.a, r.b) for r in urls.link_edges(bare).collect()} == {("h.test/", "h.test/x"), ("h.test?q", "h.test/?r")}


# pipeline


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    known = corpus_pipeline.known_languages(spark, docs, sf)
    assert known.columns == columns
    left = {r.doc_id: r for r in known.collect()}
    assert 0.9 * len(kept) < len(left) <= len(kept)
    known = spark.createDataFrame(list(left.values()), docs.schema)
    group = plain.components([(d, r.text) for d, r in left.items()], least=80, k=5)
    one = corpus_pipeline.one_of_near_copies(spark, known, sf)
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in group.values()})
    clean = corpus_pipeline.without_test_items(spark, one, sf)
    assert clean.columns == columns
    mix = corpus_pipeline.mixed(spark, clean, sf)
    assert mix.columns == columns
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in mix.collect())
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_pipeline_near_copies(spark, sf):
    rng = random.Random(10)
    docs = []
    for group in range(8):
        base = sentence(rng, 300, 10**6)
        docs += [(100 * group + 7, base), (100 * group + 3, f"{base} {sentence(rng, 45 + 4 * group, 10**6)}")]
        short = sentence(rng, 49 + group, 10**6).split()
        docs += [(100 * group + 20, " ".join(short)), (100 * group + 21, " ".join([*short[:25], "new", *short[26:]]))]
        docs += [(100 * group + 30, base + " far " * 2 + sentence(rng, 90, 10**6))]  # 0.76 at most
    held = {d: plain.shingles(t, 5) for d, t in docs}
    like = lambda a, b: len(held[a] & held[b]) / len(held[a] | held[b])
    label = {d: d for d in held}
    for a in held:
        for b in held:
            if like(a, b) >= 0.8 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    assert len(set(label.values())) < len(docs)
    one = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(label.values()))
