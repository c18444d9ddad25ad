"""Language-model data operators: brute force, round trips, bounds, nulls, empty and very long texts, repeats."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.llm import containers, cues, leaks, percentiles, spam

WORDS = "river stone lamp winter copper gate under seven barrels clerk without asking notary from amber wall until objected writing pilot cold harbour third measure drifted past".split()


def _text(rng, n):
    return [rng.choice(WORDS) + (str(rng.randint(0, 9)) if rng.random() < 0.3 else "") for _ in range(n)]


# ---- 9 leaks


def _longest(doc, item):
    best, prev = 0, {}
    for w in doc:
        cur = {}
        for j, v in enumerate(item):
            if v == w:
                cur[j] = prev.get(j - 1, 0) + 1
                best = max(best, cur[j])
        prev = cur
    return best


def test_search_matches_brute_force():
    rng = random.Random(1)
    items = [(i, " ".join(_text(rng, rng.randint(5, 40)))) for i in range(30)]
    pats = leaks.Patterns(items)
    for _ in range(150):
        doc = _text(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(items)[1].split()
            n = rng.randint(8, 16)
            a = rng.randint(0, max(0, len(own) - n))
            at = rng.randint(0, len(doc))
            doc[at:at] = own[a : a + n]
        fold = lambda t: cues.skeleton(" ".join(t).encode())
        want = {i for i, t in items if _longest(fold(doc), fold(t.split())) >= 12}
        assert pats.search(" ".join(doc)) == want


PASSAGE = "Having crossed Mendov at dusk, the warden of Zarnik refilled während sixty hours every weathered kiln until Briska objected"
SRT = "1\n00:00:01,000 --> 00:00:04,000\n- Having cr0ssed Mendov at dusk,\n\n2\n00:00:05,000 - > 00:00:07,000\n[BELL RINGS] <i>thc vvarden of Zarnik refiIled wÃ¤hrend\n\n3. O0:00:08,000 --› 00:00:09,000\nsixty hours every weatliered kiIn</i> (sighs)\nuntil Briska\n"
CASES = {
    "whole": (SRT, True),
    "dos": (SRT.replace("\n", "\r\n"), True),
    "mac": (SRT.replace("\n", "\r"), True),
    "frames": ("{10}{20}Having crossed Mendov at dusk,|the warden of\n{30}{40}Zarnik refilled w�hrend sixty hours every", True),
    "capitals": (PASSAGE.upper(), True),
    "cyrillic": (PASSAGE.replace("ä", "д"), True),
    "short": (" ".join(PASSAGE.split()[:11]), False),
    "order": (" ".join(reversed(PASSAGE.split())), False),
    "broken": (" ".join(PASSAGE.split()[:9]) + " nothing " + " ".join(PASSAGE.split()[9:]), False),
    "empty": ("", False),
    "long": ("the river is cold. " * 60_000 + PASSAGE, True),
}


def test_leaks_in_damaged_subtitles(spark):
    names = list(CASES)
    docs = [(i, CASES[n][0]) for i, n in enumerate(names)] + [(100, CASES["whole"][0]), (100, CASES["whole"][0]), (101, None), (None, CASES["whole"][0])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(3))
    items = [(1, "True or false? " + PASSAGE), (2, "too short an item"), (3, None), (None, PASSAGE), (4, "True or false? " + " ".join(f"only{i}" for i in range(10)))]
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))
    want = sorted([(i, 1) for i, n in enumerate(names) if CASES[n][1]] + [(100, 1), (100, 1)])
    assert sorted(map(tuple, leaks.find_leaks(d, it).collect())) == want
    many = spark.createDataFrame([(i, PASSAGE if i == 7 else f"item {i} " + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(10)], "item_id long, text string")
    assert {r.item_id for r in leaks.find_leaks(d, many, block_chars=300).collect()} == {7}
    assert leaks.find_leaks(d.where("false"), it).count() == 0 and leaks.find_leaks(d, it.where("false")).count() == 0


def test_instruction_is_no_passage(spark):
    """Leading sentences that many items share are found and cut off, in turn; one that few share stays."""
    heads = ["Read the passage and answer all of the many questions that stand below it.", "Think well: ", "Only here and in no other item does this rather long sentence stand first."]
    items = [(i, f"{heads[0]} {heads[1]}" + " ".join(f"w{i}x{k}" for k in range(15))) for i in range(20)] + [(99, heads[2] + " one two three")]
    it = spark.createDataFrame(items, "item_id long, text string")
    assert leaks.standing_instructions(it, "text") == (heads[0], heads[1].strip())
    d = spark.createDataFrame([(1, heads[0]), (2, heads[2]), (3, "so " + " ".join(f"w4x{k}" for k in range(12)))], "doc_id long, text string")
    assert sorted(map(tuple, leaks.find_leaks(d, it).collect())) == [(2, 99), (3, 4)]
    assert sorted(map(tuple, leaks.find_leaks(d, it, instructions=(heads[2],)).collect()))[:2] == [(1, 0), (1, 1)]
    assert leaks.standing_instructions(it.where("false"), "text") == ()


SCRIPTS = {
    "cyrillic": "в старом порту у самой воды стоял одинокий смотритель маяка и ждал корабль с далёкого севера",
    "greek": "το παλιό καράβι έφυγε νωρίς από το λιμάνι και κανείς δεν είδε τον καπετάνιο ποτέ ξανά",
    "chinese": "灯塔看守人在黎明前离开了港口",
    "brackets": "the warden (who had waited) counted forty [iron] kettles near the *old* gate before the second bell rang twice again",
    "accents": "à la fin du jour on ferma ô combien de portes à",
}


@pytest.mark.parametrize("script", list(SCRIPTS))
def test_leaks_in_any_script(script):
    """A copy is found, also in capitals, with an accent stripped or a letter misread; other words are not."""
    text = SCRIPTS[script]
    pats = leaks.Patterns([(1, text)])
    assert pats.search("1\n00:00:01,000 --> 00:00:02,000\n" + text.upper()) == {1}
    assert pats.search("foo " + text + " bar") == {1}
    assert pats.search(" ".join(reversed(text.split())) if " " in text else text[::-1]) == set()
    if script == "cyrillic":
        assert pats.search(text.replace("о", "0").replace("ё", "е")) == {1}
        assert pats.search(" ".join(text.split()[:11])) == set()


def test_lone_letters_count_at_the_edges():
    """Twelve words of which the first and last leave no trace; eleven are too few, however they are read."""
    words = "à la fin du jour on ferma vite neuf portes de à".split()
    pats = leaks.Patterns([(1, " ".join(words) + " bois brun")])
    assert len(words) == 12
    for text in (" ".join(words), " ".join(words).replace("à", "Ã"), "ou " + " ".join(words) + " non"):
        assert pats.search(text) == {1}
    assert pats.search(" ".join(words[1:])) == set() and pats.search(" ".join(words[1:-1])) == set()
    assert pats.search("– " + " ".join(words[1:-1]) + " ...") == set()


def test_unclosed_bracket_swallows_nothing():
    text = "1\n00:00:01,000 --> 00:00:02,000\n(the door\n\n2\n00:00:03,000 --> 00:00:04,000\nopens) slowly [BELL\nRINGS] again\n"
    assert cues.spoken(text).split() == b"(the door opens) slowly again".split()


# ---- 10 spam

SPEECH = ["The heavy bridge near the drawer wanted nothing.", "Did you see who opened the polite blanket?", "Hörst du, Neja? Gebäude ist seltsam.", "Il n'y a plus de bateau ici.", "No lo sé, Orrit.", "Har du åpnet det, Tavma?"]
SPAM = {
    "stuffed": ["shoes is the shoes for cheap shoes shoes", "Buy shoes sale with shoes sale cheap shoes and get shoes sale cheap", "Our shoes: cheap shoes, shoes, top shoes"],
    "tags": ["#cheapshoes #sale #cheapshoes #bonus", "#bonus #sale #cheapshoes"],
    "links": ["shoes sale http://shoes-sale1.example/shoes", "www.sale-shoes4.invalid/x?id=7", "cheap >> shoes-9.test", '<a href="http://a-b.example">sale</a>'],
    "articles": ["shoes | SKU-12345 | sale | 12.99 | cheap", "sale | SKU-54321 | shoes | 99.99 | shoes"],
    "lists": ["labels: shoes; cheap sale; bonus; shoes; bonus", "tags - bonus; shoes; cheap sale; cheap sale"],
    "pas": ["rapide pas rapide near you rapide", "Buy pas with pas rapide and get pas rapide", "pas is the pas for rapide pas"],
    "nouns": ["shoes sale bonus cheap price order deal", "price deal shoes order bonus sale cheap"],
}
FAIR = {
    "shouts": ["Neja! Neja! Neja!", "No! No! No!", "Go, go, go!", "Neja, wait!"] * 3,
    "song": ["♪ No lo sé, Melja ♪", "♪ Hemos abierto un camino ayer ♪"] * 5,
    "credits": ["Sound: Melil Quosund", "Camera: Dasil Yrfell", "Script: Suja Marness", "Driver: Keven Vasrok"],
    "units": ["Second unit: Bririt Brustad", "Second unit: Vinska Quosund", "Editing: Suven Yrvik", "Second unit: Orpo Tveness", "Second unit: Keven Vasdal", "Second unit: Loja Brurok", "Camera: Neven Vasfell"],
    "advert": [*SPEECH, "Support us and become a member at www.subs.example", *SPEECH],
    "speech": SPEECH * 2,
}


def _srt(lines):
    return "".join(f"{i + 1}\n00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},900\n{t}\n\n" for i, t in enumerate(lines))


FOREIGN_SPAM = ["обувь купить обувь дешево обувь купить", "дешево обувь купить обувь дешево обувь"], ["鞋子促销鞋子促销鞋子", "便宜鞋子便宜鞋子"]
FOREIGN_FAIR = ["Я не знаю, где она живёт.", "кто открыл эту старую дверь сегодня ночью", "Мы видели реку и мост"], ["我不知道她住在哪里。", "昨天晚上谁打开了那扇旧门", "我们看见了河和桥"]


@pytest.mark.parametrize("k", [0, 1])
def test_spam_in_other_scripts(k):
    assert spam.spam_share(_srt(FOREIGN_SPAM[k] * 5)) > 0.5
    assert spam.spam_share(_srt(FOREIGN_FAIR[k] * 5)) < 0.2
    assert spam.spam_share(_srt(FOREIGN_SPAM[k] + FOREIGN_FAIR[k] * 3)) < 0.5


@pytest.mark.parametrize("kind", list(SPAM))
def test_spam_kinds(kind):
    lines = SPAM[kind] * 6
    for text in (_srt(lines), "\n".join(lines), _srt(lines + SPEECH * 1).replace("\n", "\r\n")):
        assert spam.spam_share(text) > 0.5
    assert spam.spam_share(_srt(SPAM[kind][:1] + SPEECH * 3)) < 0.5


@pytest.mark.parametrize("kind", list(FAIR))
def test_fair_texts(kind):
    assert spam.spam_share(_srt(FAIR[kind])) < 0.5


def test_spam_table(spark):
    bad = _srt(SPAM["tags"] * 6)
    rows = [(1, bad), (1, bad), (2, _srt(SPEECH)), (3, ""), (4, None), (None, bad), (5, " \n\n1\n"), (6, bad * 3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spam_share", F.lit(0))
    assert sorted(r.doc_id for r in spam.find_spam(d).collect()) == [1, 1, 6]
    assert spam.find_spam(d.where("false")).count() == 0


# ---- 4 percentiles


def _worst(v, got, probs):
    v = np.sort(v)
    out = 0
    for p, x in zip(probs, got):
        want = max(1, int(np.ceil(p * len(v) - 1e-9)))
        lo, hi = np.searchsorted(v, x, "left") + 1, np.searchsorted(v, x, "right")
        out = max(out, lo - want, want - hi)
    return out


@pytest.mark.parametrize("kind", ["random", "sorted", "lumps", "one"])
@pytest.mark.parametrize("n", [1, 100, 5000, 300_000])
def test_rank_error_stays_in_bound(kind, n):
    rng = np.random.default_rng(n)
    v = {"random": rng.standard_cauchy(n), "sorted": np.arange(n, dtype=float), "lumps": rng.integers(0, 5, n).astype(float), "one": np.full(n, 3.0)}[kind]
    parts = []
    for piece in np.array_split(v, 7):
        s = percentiles.Sketch()
        for chunk in np.array_split(piece, 3):
            s.add(chunk)
        parts.append(s)
    whole = percentiles.Sketch()
    for s in parts:
        for row in s.rows():
            whole.take(*row)
    probs = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    count, got, bound = whole.quantiles(probs)
    assert count == n and _worst(v, got, probs) <= bound
    assert bound <= max(0.01 * n, 0) if n > 100_000 else bound <= 0.2 * n
    assert sum(len(b) for bs in whole.full.values() for b in bs) <= percentiles.K * percentiles.FAN * 8


def test_days_join_to_the_whole(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if i % 3 else f"t{i % 11}", int(i % 5), float(v)) for i, v in enumerate(rng.normal(size=30_000))]
    rows += [("hot", 1, None), ("hot", 1, float("nan")), (None, 1, 2.0), (None, None, 4.0), ("void", 1, None)]
    d = spark.createDataFrame(rows, "tile string, day int, value double").withColumn("part", F.lit(1)).withColumn("weight", F.lit("clash")).repartition(9)
    days = percentiles.merge(percentiles.sketch(d, ["tile", "day"], "value"), ["tile", "day"])
    probs = {"median": 0.5, "p95": 0.95}
    for rows_per_task in (512, 8):
        got = {r.tile: r for r in percentiles.percentiles(percentiles.merge(days, ["tile"], rows_per_task=rows_per_task), ["tile"], probs).collect()}
        for t, r in got.items():
            v = np.array([x[2] for x in rows if x[0] == t and x[2] is not None and x[2] == x[2]])
            assert r.n == len(v) and _worst(v, [r.median, r.p95], [0.5, 0.95]) <= r.max_rank_error <= 0.05 * len(v)
        assert "void" not in got and got[None].n == 2
    e = d.where("false")
    assert percentiles.percentiles(percentiles.merge(percentiles.sketch(e, ["tile"], "value"), ["tile"]), ["tile"], probs).count() == 0


# ---- 8 containers


def test_plan_holds_every_item_once():
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(1, 257, 120))
    counts = rng.integers(1, 400, len(lengths))
    ends = containers.boundaries(lengths, counts, 8)
    runs, n = containers.plan(lengths, counts, 256, ends)
    load, seen = np.zeros(n, int), {}
    for length, a, b, first, k in runs:
        for rank in range(a, b):
            assert (length, rank) not in seen
            seen[length, rank] = first + (rank - a) // k
            load[first + (rank - a) // k] += length
    assert len(seen) == counts.sum() and load.max() <= 256 and (load * 1.0).sum() / (n * 256) > 0.97


def test_boundaries_are_optimal():
    lengths, counts = np.array([1, 2, 3, 8, 9, 20]), np.array([5, 1, 7, 2, 3, 1])

    def padding(ends):
        up = np.array(ends)[np.searchsorted(ends, lengths, "left")]
        return (counts * (up - lengths)).sum()

    import itertools

    for k in (1, 2, 3, 6):
        best = min(padding(sorted({*c, 20})) for c in itertools.combinations(lengths, min(k, 6)) if len({*c, 20}) <= k)
        assert padding(containers.boundaries(lengths, counts, k)) == best


def test_boundaries_are_optimal_over_many_lengths():
    rng = np.random.default_rng(11)
    lengths = np.sort(rng.choice(np.arange(1, 4000), 700, replace=False))
    counts = rng.integers(1, 50, 700)
    counts[350] = 1_000_000  # one common length must not hide the others
    c, s = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    best = [int(lengths[j] * c[j + 1] - s[j + 1]) for j in range(700)]
    for _ in range(4):  # all pairs, without any choice of levels
        best = [min([best[j], *(best[i - 1] + int(lengths[j] * (c[j + 1] - c[i]) - (s[j + 1] - s[i])) for i in range(1, j + 1))]) for j in range(700)]
    ends = containers.boundaries(lengths, counts, 5)
    assert len(ends) <= 5 and (counts * (ends[np.searchsorted(ends, lengths, "left")] - lengths)).sum() == best[-1]


def test_bucket_ends_shape_the_batches():
    lengths, counts = np.array([3, 4, 9, 10]), np.array([10, 10, 2, 2])
    first = lambda ends: sorted((n, k) for n, _, _, c, k in containers.plan(lengths, counts, 29, np.array(ends))[0] if c == 0)
    # two items of the bucket (4, 10] are sure to fit; the rest is topped up from shorter buckets
    assert first([4, 10]) == [(4, 2), (10, 2)]
    assert first([9, 10]) == [(9, 1), (10, 2)]
    # no shorter bucket is left: the space goes to the bucket itself
    assert first([10]) == [(9, 1), (10, 2)]


def test_fill_round_trip(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(_text(rng, rng.randint(1, 120)))) for i in range(400)] + [(7, "twice sent"), (7, "twice sent"), (900, ""), (901, None), (None, "x"), (902, "word " * 5000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).repartition(6)
    got = containers.fill(d, capacity=256).collect()
    count = {r.doc_id: r.n_tokens for r in containers.token_counts(d).where("doc_id >= 900").collect()}
    by_doc, load = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.n_tokens))
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert set(by_doc) == {*range(400), 900, 901, 902} and len(by_doc[7]) == 3
    assert max(load.values()) <= 256 and set(load) == set(range(len(load)))
    big = sorted(by_doc[902])
    assert sum(p[2] for p in big) == count[902] and [p[2] for p in big[:-1]] == [256] * (len(big) - 1) and [p[1] for p in big] == [256 * i for i in range(len(big))]
    assert all(len(v) == 1 for k, v in by_doc.items() if k not in (7, 902)) and by_doc[900] == [(0, 0, 0)] == by_doc[901]
    f = containers.filling(containers.fill(d, capacity=256), 256).first()
    assert f.used > 0.95 and f.fullest <= 256
    assert containers.fill(d.where("false")).count() == 0
