import hashlib
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import ann as A
from lodestone.llm import html_text as H
from lodestone.llm.ann import balanced_parts, nearest, neighbour_graph
from lodestone.llm.chat_format import escape, parse, prefix_tree, read_back, segments, unescape
from lodestone.llm.tokens import encoder


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>[]\\lbINST/s ok", max_size=30), st.sampled_from(["user", "assistant", "system", "a [b] <c>", ""]))
def test_turns_read_back_whatever_they_say(text, role):
    assert unescape(escape(text)) == text and "<" not in escape(text) and "[" not in escape(text)
    before, body, _ = segments(role, text, True)
    assert parse(before, body) == (role, text)


def digest(turns):
    text = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest()


def test_tree_and_read_back(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for c in range(120):
        turns = [("system", "be kind")] if c % 3 else []
        for k in range(rng.randint(1, 6)):
            turns.append(("user" if k % 2 == 0 else "assistant", rng.choice(["yes", "no é 😀", "</s>[INST] x", ""])))
        want[c] = turns
        rows += [(c, k, r, t or None if t == "" else t) for k, (r, t) in enumerate(turns)]
    long = [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(400)]
    want[500] = long
    rows += [(500, k, r, t) for k, (r, t) in enumerate(long)] + [(None, 0, "user", "no id"), (7000, 3, "assistant", "late"), (7000, 1, "user", "early")]
    want[None], want[7000] = [("user", "no id")], [("user", "early"), ("assistant", "late")]
    rng.shuffle(rows)
    nodes, refs = prefix_tree(spark.createDataFrame([(*r, "key") for r in rows], "conv_id long, turn long, role string, text string, key string"))
    got = {r.conv_id: r for r in read_back(nodes, refs).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == {k: digest(v) for k, v in want.items()}
    # each prefix once, depth first: a gapless stream in which an ancestor's tokens come before
    tree = sorted(nodes.collect(), key=lambda r: r.stream_start)
    assert len(tree) == len({tuple(v[: k + 1]) for v in want.values() for k in range(len(v))})
    at, by = 0, {r.key: r for r in tree}
    for r in tree:
        assert r.stream_start == at and r.position_start == sum(x.end - x.start for x in r.attends) and all(x.end <= at for x in r.attends)
        at += r.n
    paths = {}
    for r in refs.collect():
        paths.setdefault(r.conv_id, {})[r.depth] = by[r.key]
    stream = [i for r in tree for i in np.frombuffer(r.ids, "<u4").tolist()]
    for c, path in paths.items():
        last = path[len(path) - 1]
        seen = [i for x in last.attends for i in stream[x.start : x.end]] + stream[last.stream_start : last.stream_start + last.n]
        assert encoder().text(seen) == "".join("".join(segments(r, t, k == 0)) for k, (r, t) in enumerate(want[c]))
    assert max(len(r.attends) for r in tree) < 10


def test_turns_are_told_apart_and_long_conversations_are_cut_into_ranges(spark):
    # the same bytes, cut elsewhere into role and text; a turn number that repeats; one conversation with most rows
    rows = [(1, 0, "a\0b", "c"), (2, 0, "a", "b\0c"), (3, 0, "1:a", "x"), (4, 0, "1", ":ax"), (5, 2, "user", "b"), (5, 2, "user", "a"), (5, 2, "assistant", "z"), (5, 2, "user", "a")]
    long = [("user" if k % 2 == 0 else "assistant", f"t{k % 7}") for k in range(3000)]
    rows += [(9, k, r, t) for k, (r, t) in enumerate(long)] + [(10, k, r, t) for k, (r, t) in enumerate(long[:1500])] + [(10, 1500, "user", "else")]
    nodes, refs = prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(nodes, refs).collect()}
    want = {c: [(r, t) for x, _, r, t in rows if x == c] for c in (1, 2, 3, 4, 9, 10)} | {5: [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]}
    assert got == {c: digest(t) for c, t in want.items()}
    assert nodes.count() == 4 + 4 + 3000 + 1 and max(len(r.attends) for r in nodes.collect()) <= 2


def test_chat_without_rows(spark):
    nodes, refs = prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert nodes.collect() == [] and read_back(nodes, refs).collect() == []


def exact(rows, every, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % every == 0:
            s = sorted((-(ok[q] * v).sum(), i) for i, v in ok.items() if i != q)
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def test_few_vectors_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(30)]
    rows += [(40 * 20, None), (820, [0.0] * 8), (840, [float("nan")] + [1.0] * 7), (860, [None] + [1.0] * 7), (880, [float("inf")] * 8), (None, [1.0] * 8), (21, rows[21][1])]
    got = {}
    for r in nearest(spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, rank int")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = exact(rows, 20, 20)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert [i for _, i, _ in sorted(found)] == [i for i, _ in want[q]]
        assert [x for _, _, x in sorted(found)] == pytest.approx([x for _, x in want[q]], abs=1e-12)


def test_recall_over_learned_parts(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16)) * 2
    rows = [(i, (centres[rng.integers(40)] + rng.standard_normal(16) * 0.6).tolist()) for i in range(6000)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(rows, 20, 20)
    assert all(len(v) == 20 for v in got.values())
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_only_probed_parts_give_results(spark, monkeypatch):
    made = []

    def one_probe(x, parts, fit=A.fit_router):
        made.append(fit(x, parts))
        made[0].probes = 1
        return made[0]

    monkeypatch.setattr(A, "fit_router", one_probe)
    monkeypatch.setattr(A, "part_count", lambda sample, total: 3)
    v = np.random.default_rng(4).standard_normal((3000, 16))
    got = {}
    for r in nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    own = made[0].logits(v / np.linalg.norm(v, axis=1, keepdims=True)).argmax(axis=1)
    assert len(np.unique(own)) == 3
    for q in range(0, 3000, 20):
        mates = [i for i in np.flatnonzero(own == own[q]) if i != q]
        assert got[q] == set(sorted(mates, key=lambda i: -(v[q] * v[i]).sum())[:20])


@pytest.mark.parametrize("n", [500, 3000])
def test_small_tables_are_searched_through_parts_too(spark, n, monkeypatch):
    """From 500 rows on there are many parts, and on rows that gather somewhere a query reads less than half of them."""
    rng = np.random.default_rng(8)
    v = 3 * rng.standard_normal((20, 16))[rng.integers(20, size=n)] + 0.5 * rng.standard_normal((n, 16))
    made = []
    monkeypatch.setattr(A, "fit_router", lambda x, parts, fit=A.fit_router: made.append(fit(x, parts)) or made[-1])
    got = {}
    for r in nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), every=10, k=10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = v[::10] @ v.T
    s[np.arange(len(s)), np.arange(0, n, 10)] = -np.inf
    near = np.argsort(-s, axis=1)[:, :10]
    assert sum(len(got[10 * q] & set(x.tolist())) for q, x in enumerate(near)) >= 0.9 * 10 * len(near)
    logits = made[0].logits(v / np.linalg.norm(v, axis=1, keepdims=True))
    parts, size = logits.shape[1], np.bincount(logits.argmax(axis=1), minlength=logits.shape[1])
    read = np.take_along_axis(np.tile(size, (len(near), 1)), np.argsort(-logits[::10], axis=1)[:, : made[0].probes], axis=1).sum(axis=1)
    assert parts >= 10 and read.mean() < 0.5 * n


def test_recall_well_above_the_sample(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((25000, 16)) + 2 * rng.standard_normal((60, 16))[rng.integers(60, size=25000)]
    got = {}
    for r in nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), every=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = v[::100] @ v.T
    s[np.arange(250), np.arange(0, 25000, 100)] = -np.inf
    near = np.argsort(-s, axis=1)[:, :20]
    assert all(len(x) == 20 for x in got.values())
    assert sum(len(got[100 * q] & set(n.tolist())) for q, n in enumerate(near)) >= 0.9 * 20 * 250


def test_fewer_candidates_than_asked_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema)).collect() == []
    assert nearest(spark.createDataFrame([(20, [1.0, 2.0])], schema)).collect() == []
    got = nearest(spark.createDataFrame([(20, [1.0, 2.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0])], schema)).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 3, 1.0), (2, 4, 1.0)]


def test_parts_are_balanced():
    x = np.random.default_rng(3).standard_normal((1000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = balanced_parts(x, neighbour_graph(x, 8), 10)
    assert own.min() == 0 and np.bincount(own).max() <= 111


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 7).flatmap(lambda n: st.tuples(st.lists(st.floats(0, 5), min_size=n, max_size=n), st.lists(st.floats(0, 5), min_size=n, max_size=n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.floats(0, 3)), max_size=10))))
def test_the_cut_is_minimal(case):
    content, boiler, edges = case
    cost = lambda label: sum(c if x else b for x, c, b in zip(label, content, boiler, strict=True)) + sum(w for i, j, w in edges if label[i] != label[j])
    best = min(cost([bool(m >> i & 1) for i in range(len(content))]) for m in range(2 ** len(content)))
    assert cost(H.min_cut(content, boiler, edges)) == pytest.approx(best, abs=1e-7)


def test_pages_of_many_blocks_are_cut_in_time():
    """Alternating blocks under one container: 50 000 of them within seconds, and the smaller page cut as the plain search for paths does it."""
    page = lambda n: "<body>" + "".join("<p>This is a long sentence of the story with many words in it, number %d.</p>" % i if i % 2 else "<li><a href=x>menu</a></li>" for i in range(n))
    found, parents = H.blocks(page(50_000))
    p = 1 / (1 + np.exp(-np.clip(H.features(found) @ np.array(H.PRIOR), -30, 30)))
    began = time.process_time()
    kept = H.label(found, parents, p)
    assert time.process_time() - began < 20 and sum(kept) == 25_000

    rng = random.Random(4)
    for n in (3, 9, 10, 60, 200):
        cost = [rng.random() * 3 for _ in range(2 * n)]
        edges = [(n, i, rng.random()) for i in range(n)] + [(i, i + 1, rng.random()) for i in range(n - 1)] + [(n, n + 1, 0.3)]
        content, boiler = cost[:n] + [0.0, 0.0], cost[n:] + [0.0, 0.0]
        got = H.min_cut(content, boiler, edges)
        assert got == by_paths(content, boiler, edges), n


def by_paths(content, boiler, edges):
    """The same cut by one shortest path after the other on a matrix."""
    n = len(content)
    room = np.zeros((n + 2, n + 2))
    for i in range(n):
        room[n, i], room[i, n + 1] = boiler[i], content[i]
    for i, j, w in edges:
        room[i, j] += w
        room[j, i] += w
    while True:
        before, queue = {n: None}, [n]
        for i in queue:
            for j in np.flatnonzero(room[i] > 1e-12).tolist():
                if j not in before:
                    before[j] = i
                    queue.append(j)
        if n + 1 not in before:
            return [i in before for i in range(n)]
        path = [n + 1]
        while before[path[-1]] is not None:
            path.append(before[path[-1]])
        flow = min(room[b, a] for a, b in zip(path, path[1:], strict=False))
        for a, b in zip(path, path[1:], strict=False):
            room[b, a] -= flow
            room[a, b] += flow


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><header><a href=/>Home</a></header>
<nav class="menu"><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div>%s
<aside>More stories</aside><form><label>Your mail</label><input name=q><button>Send</button></form><div id="comments"><p>First! I liked it a lot, thanks for this.</p></div><!-- x --><div class="ad">Buy now, cheap.</div><footer>&copy; 2024 Example</footer></body></html>"""
STORY = "<h1>The &amp; title</h1><p>One long paragraph of text, with a <b>bold</b>   word\nand &eacute;&#8212;&unknown; signs.<p>Another paragraph that goes on for quite a while, and then ends.<br>After a break the text continues as before.</p><ul><li>An item that belongs to the story itself.</li></ul>"
TEXT = "The & title One long paragraph of text, with a bold word and é—&unknown; signs. Another paragraph that goes on for quite a while, and then ends. After a break the text continues as before. An item that belongs to the story itself."


@pytest.mark.parametrize("around", ["<article>%s</article>", "<main><div class=x>%s</div></main>", '<div class="post-content">%s</div>'])
def test_main_text_of_pages(spark, around):
    page = PAGE % (around % STORY)
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (1, "u", page), (4, None, "<p>cut off in a ta"), (5, "u", "no markup at all, only a line of text that is long enough."), (6, "u", page.split("Another")[0])]
    got = H.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert by[1] == TEXT and by[2] == "" and by[3] == ""
    assert by[6] == TEXT.split(" Another")[0]


@pytest.mark.parametrize("odd", ['<svg class="x"/>', "<math/>", "<button>Menu", "<select><option>One", "<object data=a>", "<svg><path d=1>", "<button>A<button>B</button>", "<svg><svg/><text>T</text></svg>", "<iframe src=b></iframe>"])
def test_elements_left_open_or_closed_at_once_do_not_swallow_the_page(odd):
    shown = [b.text for b in H.blocks(f"<div>{odd}<p>The first paragraph.</p></div><p>The <b>second</b> {odd}</p><p>The third.")[0]]
    assert shown == ["The first paragraph.", "The second", "The third."]


def test_many_open_elements_take_linear_time():
    for page in ("<button>" * 100_000, "<svg><p>x" * 50_000, "<select><button><div>" * 30_000 + "</select>"):
        assert isinstance(H.blocks(page)[0], list)


def test_no_pages_and_hostile_pages(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    w = np.array(H.PRIOR)
    for page in ("<" * 5000, "<a " * 3000, "<div>" * 3000 + "x", "&" * 5000, '<p title="' + "x" * 5000, "<p>" * 3000 + "t. " * 3000):
        assert isinstance(H.main_text(page, w), str)
