import numpy as np
import pytest

from loomgraph.llm import spam

PROSE = "I replaced the chain yesterday, and now it works again. Has anyone here tried the cheap one? It took two hours until the noise stopped."
TAGS = "Tags: " + ", ".join(["cheap gear", "best gear", "gear sale 2024", "gear", "online gear discount"] * 12)
KEYWORDS = "gear lamp best gear gear lamp sale gear cheap lamp gear gear lamp online gear " * 6
LINKS = "\n".join(f"* https://www.gear{i}.example/p/{i}" for i in range(15))
ANCHORS = "\n".join(f"[url=http://g{i}.test/a]cheap gear[/url]" for i in range(15))
MENU = "\n".join(["Gear sale", "Lamp sale", "Best price", "Cheap gear", "Gear lamp"] * 6)
PRODUCTS = " | ".join(f"Lum SKU {40000 + i} / gear / ${100 + i} / NEW" for i in range(12))
LIST_WITH_TEXT = "\n".join(f"- https://www.otter{i}.test/\n  {PROSE}" for i in range(5))

POSTS = {
    1: (PROSE, False), 2: (TAGS, True), 3: (KEYWORDS, True), 4: (LINKS, True), 5: (ANCHORS, True), 6: (MENU, True), 7: (PRODUCTS, True), 8: (LIST_WITH_TEXT, False),
    9: (f"[quote=x]{TAGS}[/quote]\nThis is spam, please remove it.", False), 10: (f"joe wrote:\n> {TAGS}\n> {LINKS.replace(chr(10), chr(10) + '> ')}\n\nThanks!", False),
    11: (f"<blockquote>{KEYWORDS}</blockquote>\n+1", False), 12: (None, False), 13: ("", False), 14: ("bump", False), 15: (f"[quote=a]{PROSE}[/quote]\n{TAGS}", True),
    16: (f"{PROSE}\n{TAGS * 3}", True), 17: (f"{PROSE} {PROSE} {PROSE}\n- 5x gear\n- 2x lamp\n- 3x oven\n-- \njoe\nhttps://joe-shop.test", False),
    18: (f"{PROSE}\n[code]\n04:47 step=load rows=427074\n08:51 step=type rows=391252\n[/code]", False), 19: (f"<div><p>{LINKS.replace(chr(10), '<br>')}</p></div>", True),
}


def flagged(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, prose int")
    return sorted(r["doc_id"] for r in spam.flagged(spam.label_words(df)).collect())


def test_kinds_of_posts(spark):
    prose = [(1000 + i, f"{PROSE} Number {i} is fine, thanks.", 0) for i in range(60)]
    got = flagged(spark, [(i, t, 0) for i, (t, _) in POSTS.items()] + prose + [(2, TAGS, 0)])
    assert sorted(set(got)) == [i for i, (_, bad) in POSTS.items() if bad]
    assert got.count(2) == 2


def test_empty_table_and_long_text(spark):
    assert flagged(spark, []) == []
    assert flagged(spark, [(1, PROSE * 3000, 0), (2, (LINKS + "\n") * 1000, 0)]) == [2]


def test_own_text():
    text = "[quote=a]x [quote=b]y[/quote] z[/quote]own\r\r\n> quoted\nmore\n-- \njoe\nhttps://x.test"
    assert spam.own_text(text).split() == ["own", "more"]
    assert spam.own_text("a [quote=b] never closed").split() == ["a"]


def test_counts_equal_those_of_a_plain_forward_backward():
    rnd = np.random.default_rng(1)
    size = int(np.prod(spam.BINS))
    obs = [rnd.integers(0, size, n) for n in (1, 2, 7, 30)]
    got = spam.expected_counts(obs, spam.PRIOR)
    emit, k = np.exp(spam.PRIOR.emissions()), 4
    start, moves, seen = np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
    for o in obs:
        f = [spam.PRIOR.start * emit[o[0]]]
        for x in o[1:]:
            f.append(f[-1] @ spam.PRIOR.moves * emit[x])
        b = [np.ones(k)]
        for x in o[:0:-1]:
            b.insert(0, spam.PRIOR.moves @ (emit[x] * b[0]))
        z = f[-1].sum()
        post = np.array(f) * np.array(b) / z
        start += post[0]
        np.add.at(seen, o, post)
        for t in range(len(o) - 1):
            moves += f[t][:, None] * spam.PRIOR.moves * (emit[o[t + 1]] * b[t + 1])[None] / z
    assert got == pytest.approx(np.concatenate([start, moves.ravel(), seen.ravel()]), rel=1e-6, abs=1e-9)


def test_labels_equal_the_best_of_all_paths():
    from itertools import product

    rnd = np.random.default_rng(2)
    emit, moves = spam.PRIOR.emissions(), np.log(spam.PRIOR.moves)
    for n in (1, 2, 5):
        o = rnd.integers(0, len(emit), n)
        best = max(product(range(4), repeat=n), key=lambda p: np.log(spam.PRIOR.start[p[0]]) + sum(emit[x, s] for x, s in zip(o, p, strict=True)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert list(spam.labels([o], spam.PRIOR)[0]) == list(best)


def test_weights_count_a_sequence_as_often():
    rnd = np.random.default_rng(4)
    obs = [rnd.integers(0, int(np.prod(spam.BINS)), n) for n in (1, 3, 8)]
    many = spam.expected_counts([obs[0], obs[1], obs[1], obs[2], obs[2], obs[2]], spam.PRIOR)
    assert spam.expected_counts(obs, spam.PRIOR, np.array([1.0, 2.0, 3.0])) == pytest.approx(many, rel=1e-9, abs=1e-12)


def test_the_prior_fades_with_the_data():
    size = int(np.prod(spam.BINS))
    flat = np.concatenate([np.array([0, 1.0, 0, 0]), np.zeros(16), np.zeros(size * 4)])
    assert spam.updated(spam.PRIOR, flat).start == pytest.approx(spam.START, abs=1e-3)
    assert spam.updated(spam.PRIOR, flat * 1e8).start[1] > 0.999


def test_fitting_ends_when_nothing_changes(spark):
    df = spark.createDataFrame([(i, PROSE if i % 4 else LINKS) for i in range(40)], "doc_id long, text string")
    observations = df.mapInArrow(spam._observations, "doc_id long, obs array<int>, words array<int>")
    done = spam.fit(observations)
    assert spam._change(spam.fit(observations, tolerance=spam.TOLERANCE / 5), done) < 0.05


def test_nothing_is_cut_off():
    """Ends, attributions, anchors and tags of any length."""
    assert spam.observe("It works" + " " * 500 + ".")[0] // int(np.prod(spam.BINS[1:])) == 4
    assert spam.own_text("x" * 300 + " wrote:\n> quoted\nmine").split() == ["mine"]
    anchor = "word " * 100
    assert spam.units(f"[{anchor}](http://a.test/x)")[0].count(spam.ANCHOR) == 100
    assert spam.units("<b " + "c" * 500 + ">bold</b>") == ["bold"]


def test_links_of_any_host():
    for link in ("www.kettle.museum/p?x=1", "http://a-b.example", "otter.shop/a", "badger dot kettle dot travel", "hxxps://x dot coop/a", "KETTLE.ORG"):
        assert spam.units(f"see {link} now") == [f"see {spam.LINK_MARK} now"], link
    for text in ("It is 3.5 or 4.25e9", "e.g. this", "works.Then it stopped"):
        assert spam.LINK_MARK not in "".join(spam.units(text)), text
