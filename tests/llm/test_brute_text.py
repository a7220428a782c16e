"""Pages and quality against second computations that share no code with the operators."""

from __future__ import annotations

import html as markup
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from timberline.llm import html_text, quality

# --- pages: trees are known, so neither parsing nor hashing is needed to tell the text ---------

BLOCK = {"body", "div", "section", "p", "ul", "li", "article", "h2", "nav", "footer", "header", "aside"}
GONE = {"nav", "footer", "aside", "script", "button"}
SHAPES = {
    "div": ["div", "section", "p", "ul", "h2", "nav", "aside", "script", "button", "", "b"],
    "section": ["div", "p", "ul", "", "b"], "ul": ["li"], "li": ["", "b", "p"], "p": ["", "b", "i"],
    "h2": [""], "b": [""], "i": [""], "nav": ["", "ul"], "aside": ["", "p"], "script": [""], "button": [""],
}


def some_tree(rng, tag="div", depth=0):
    children = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(SHAPES[tag])
        if kind == "" or depth == 4:
            words = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(1, 6))]
            children.append(" " * rng.randint(0, 2) + " ".join(words) + rng.choice(["", " ", " & <x>"]))
        else:
            children.append(some_tree(rng, kind, depth + 1))
    return tag, children


def render(node, rng):
    if isinstance(node, str):
        text = markup.escape(node).replace(" ", rng.choice([" ", "\n\t "]))
        return text.replace("&amp;", rng.choice(["&amp;", "&#38;", "&#x26;"]))
    tag, children = node
    inner = "".join(render(c, rng) for c in children)
    if tag == "script":
        inner = "var a = '<p>no</p>';"
    return f"<{tag}>{inner}</{tag}>" + rng.choice(["", "<!-- <p>no</p> -->"])


def goes(tag, within):
    return tag in GONE or tag == "header" and "article" not in within


def subtree(node, within=()):
    """What an element is made of, or None where it shows no text."""
    tag, children = node
    if goes(tag, within):
        return None
    parts, run = [], []
    for child in [*children, None]:
        if isinstance(child, str):
            run.append(child)
            continue
        if "".join(run).strip():
            parts.append(" ".join("".join(run).split()))
        run = []
        inner = subtree(child, (*within, tag)) if child else None
        if inner:
            parts.append(inner)
    return (tag, *parts) if parts else None


def brute_blocks(page):
    """``(text, subtrees it lies in, in an article)`` in page order."""
    blocks, text = [], []

    def flush(open_):
        words = " ".join("".join(text).split())
        text.clear()
        if words:
            names = tuple(tag for tag, _ in open_)
            within = [subtree(n, names[:i]) for i, n in enumerate(open_)]
            blocks.append((words, within, "article" in names))

    def visit(node, open_):
        if isinstance(node, str):
            if not any(goes(n[0], [m[0] for m in open_[:i]]) for i, n in enumerate(open_)):
                text.append(node)
            return
        if node[0] in BLOCK:
            flush(open_)
        for child in node[1]:
            visit(child, [*open_, node])
        if node[0] in BLOCK:
            flush([*open_, node])

    visit(page, [])
    marked = [b for b in blocks if b[2]]
    return marked or blocks


def brute_texts(pages):
    """The text of each ``(host, tree)``, all counts taken by comparing the subtrees themselves."""
    read = [(host, brute_blocks(tree)) for host, tree in pages]
    sizes = Counter(host for host, _ in read)
    count, others = Counter(), defaultdict(lambda: defaultdict(set))
    for host, blocks in read:
        places = defaultdict(set)
        for n, (_, within, article) in enumerate(blocks):
            for s in within:
                places[s, article].add(n)
        longest = sorted(range(len(blocks)), key=lambda n: (-len(blocks[n][0]), blocks[n][0]))
        for (s, article), own in places.items():
            count[host, s, article] += 1
            outside = [blocks[n][0] for n in longest if n not in own][: html_text.AROUND]
            for rank, words in enumerate(outside):
                others[host, s, article][rank].add(words)
    gone = set()
    for (host, s, article), n in count.items():
        half = 2 * n >= sizes[host]
        share = html_text.ARTICLE_SHARE if article else html_text.SHARE
        if n < html_text.MIN_PAGES or not (half or n >= share * sizes[host] and n > html_text.MIN_PAGES):
            continue
        ranks = others[host, s, article]
        different = max(map(len, ranks.values()), default=0) if half and not article else len(ranks[0])
        if different >= html_text.DIFFERENT:
            gone.add((host, s))
    return ["\n".join(b[0] for b in blocks if not any((host, s) in gone for s in b[1])) for host, blocks in read]


def a_site(rng, pages, marked):
    """Pages of some own text and fragments that recur at different rates; every ninth is a copy."""
    fragments = [(some_tree(rng), rate) for rate in (0.03, 0.1, 0.2, 0.45, 0.6, 0.95) for _ in range(3)]
    copied = [some_tree(rng) for _ in range(3)]
    out = []
    for i in range(pages):
        own = [some_tree(rng) for _ in range(2)] if i % 9 else [*copied, ("p", [f"copy {i}"])]
        shared = [f for f, rate in fragments if i % 9 and rng.random() < rate]
        body = own + shared
        rng.shuffle(body)
        if marked:
            cut = rng.randint(1, len(body))
            body = [("article", [("header", ["Title of " + str(i)]), *body[:cut]]), *body[cut:]]
        out.append(("body", [("header", ["Site"]), *body, ("footer", ["Imprint"])]))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_blocks_of_known_trees(seed):
    rng = random.Random(seed)
    for page in a_site(rng, 6, seed % 2):
        got = html_text.page_blocks("<!doctype html>" + render(page, rng))
        want = brute_blocks(page)
        assert [b[0] for b in got] == [b[0] for b in want]
        assert [len(b[1]) for b in got] == [len(b[1]) for b in want]


def test_texts_of_whole_sites(spark):
    rng = random.Random(77)
    pages = [(host, tree) for host, n, marked in (
        ("a.com", 150, False), ("b.com", 150, True), ("c.com", 12, False), ("d.com", 9, True)
    ) for tree in a_site(rng, n, marked)]
    rows = [(i, f"https://{host}/p/{i}", render(tree, rng)) for i, (host, tree) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r for r in html_text.extract_text(frame).collect()}
    want = brute_texts(pages)
    whole = ["\n".join(b[0] for b in brute_blocks(tree)) for _, tree in pages]
    assert sum(a != b for a, b in zip(want, whole)) > 200  # templates are at work
    for i, text in enumerate(want):
        assert (got[i].text, got[i].n_chars) == (text, len(text)), i


# --- quality ------------------------------------------------------------------------------------


def brute_rows(text):
    words, shapes = [], []
    for word in text.encode().split():
        kinds = "".join(
            "a" if b >= 128 or 97 <= b <= 122 else "A" if 65 <= b <= 90 else "9" if 48 <= b <= 57 else chr(b)
            for b in word
        )
        shape = re.sub(r"(.)\1+", r"\1", kinds, flags=re.S)
        words.append(xxhash.xxh3_64_intdigest(word.lower()) % quality.WORDS)
        shapes.append(quality.WORDS + xxhash.xxh3_64_intdigest(shape.encode("latin-1")) % quality.SHAPES)
    return words, shapes


def brute_vectors(texts):
    """Sums over each word's place, one neighbour at a time."""
    fixed = quality.random_vectors().astype(int)
    table = np.zeros((quality.ROWS, quality.DIM), int)
    for text in texts:
        for ids in brute_rows(text or ""):
            for i in range(len(ids)):
                for j in (i - 1, i, i + 1):
                    if 0 <= j < len(ids):
                        table[ids[i]] += fixed[ids[j]]
    return [row / max(np.sqrt((row**2).sum()), 1e-300) for row in table]


def corpus(n=60):
    rng = random.Random(5)
    words = ["The", "the", "cat", "sat!", "on", "a-1", "Ünïcode", "BUY", "$9.99", "x" * 80, "ok", " "]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(n)] + ["", None, " \n"]


def test_word_vectors_equal_plain_sums(frame):
    texts = corpus()
    got = quality.word_vectors(frame(texts))
    assert np.allclose(got, np.array(brute_vectors(texts)), atol=1e-6)


def test_pooling_equals_plain_means():
    texts = corpus(25)
    vectors, fixed = brute_vectors(texts), quality.random_vectors().astype(float)
    for text in texts:
        text = text or ""
        got = quality.pooled(text, quality.WordRows(), np.array(vectors, np.float32), fixed)
        both = brute_rows(text)
        if not both[0]:
            assert not got.any()
            continue
        means = [sum(vectors[i] for i in ids) / len(ids) for ids in both]
        want = [*means[0], *means[1]]
        want += [np.linalg.norm(sum(fixed[i] for i in ids) / len(ids)) for ids in both]
        want += [np.linalg.norm(m) for m in means]
        want += [sum(a == b for a, b in zip(ids, ids[1:])) / max(len(ids) - 1, 1) for ids in both]
        assert np.allclose(got, want, atol=1e-5)


def noisy(n, seed=2):
    """Rows whose label follows a known chance, so calibration can be told."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, quality.FEATURES))
    chance = 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))
    return x, (rng.random(n) < chance).astype(float), chance


def test_scores_are_the_plain_network():
    x, y, _ = noisy(600)
    net = quality.fit_network(x, y)
    for row, score in zip(x[:20], net.score(x[:20])):
        z = [(v - m) / s for v, m, s in zip(row, net.mean, net.scale)]
        hidden = [np.tanh(sum(a * w for a, w in zip(z, column)) + b) for column, b in zip(net.w1.T, net.b1)]
        logit = sum(h * w for h, w in zip(hidden, net.w2)) + net.b2
        assert abs(score - 1 / (1 + np.exp(-logit / net.temperature))) < 1e-9


def test_temperature_is_the_best_on_rows_not_trained_on():
    x, y, _ = noisy(900)
    net = quality.fit_network(x, y, seed=3)
    # the first numbers drawn are those of the first layer; then comes the order of the rows
    rng = np.random.default_rng(3)
    rng.normal(0, 0.2, net.w1.shape)
    later = rng.permutation(len(x))[: len(x) // 5]

    def loss(t):
        p = 1 / (1 + np.exp(-net.logits(x[later]) / t))
        return -np.mean(np.log(np.where(y[later] == 1, p, 1 - p)))

    assert all(loss(net.temperature) <= loss(t) + 1e-12 for t in np.geomspace(0.25, 16, 61))
    assert net.temperature > 1  # a network fitted on 720 noisy rows is too sure of itself


def test_scores_are_calibrated():
    x, y, _ = noisy(6_000)
    fresh, _, chance = noisy(6_000, seed=8)
    net = quality.fit_network(x, y)
    score = net.score(fresh)
    for low in np.arange(0, 1, 0.2):
        inside = (score >= low) & (score < low + 0.2)
        assert abs(score[inside].mean() - chance[inside].mean()) < 0.08
