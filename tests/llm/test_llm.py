"""Operators of the text and quantile problems: brute force, planted cases, awkward inputs."""

import random
import time
import unicodedata
from collections import defaultdict

import numpy as np
import pytest

from weftline.llm.leakage import distance, leaks, normal
from weftline.llm.packing import pack, pack_lengths, step_groups, token_counts
from weftline.llm.relative_quantiles import RelativeSketch, _levels, merge_sketches, quantiles, sketch_by
from weftline.llm.sentences import languages_of, sentences, split

RANKS = [0.5, 0.9, 0.99, 0.999]


def off(values, rank, got):
    """Error of a percentile's rank, as a share of n."""
    v, n = np.sort(values), len(values)
    want = np.ceil(rank * n)
    return max(0, np.searchsorted(v, got, "left") + 1 - want, want - np.searchsorted(v, got, "right")) / n


@pytest.mark.parametrize("n", [1, 7, 299, 5000, 400_000])
def test_sketch_error(n):
    rng = np.random.default_rng(n)
    for shape in (rng.lognormal(8, 2, n), np.arange(n), np.arange(n)[::-1], rng.integers(0, 3, n)):
        values = np.asarray(shape, np.int64)
        parts = []
        for i, part in enumerate(np.array_split(values, 5)):
            parts.append(RelativeSketch(seed=i))
            for batch in np.array_split(part, 7):
                parts[-1].update(batch)
        while len(parts) > 1:  # in a tree, in any order
            parts[0].merge(parts.pop())
            parts = parts[::-1]
        sketch = parts[0]
        assert sketch.n == n == sum((1 << h) * level.held for h, level in enumerate(sketch.levels))
        for rank, got in zip(RANKS, sketch.quantiles(RANKS), strict=True):
            assert off(values, rank, got) <= sketch.error(rank)
        assert sum(level.held for level in sketch.levels) < 8000


def test_sketches_by_key(spark):
    rng = random.Random(1)
    data = [(rng.choice([1, 1, 1, 2]), rng.choice([0, 1]), rng.randrange(10**6)) for _ in range(6000)] + [(None, 0, 5), (1, 0, None), (3, 0, 4)]
    df = spark.createDataFrame(data, "k int, d int, v long").selectExpr("*", "'x' AS n", "1 AS items", "2 AS held")
    groups, whole = defaultdict(list), defaultdict(list)
    for k, d, v in data:
        if k is not None and v is not None:
            groups[k, d].append(v)
            whole[k].append(v)
    by_day = sketch_by(df, ["k", "d"], "v")
    for r in quantiles(by_day, ["k", "d"]).collect():
        own = groups.pop((r.k, r.d))
        assert r.n == len(own) and r.greatest == max(own)
        assert all(off(own, q, r[c]) <= r[f"{c}_rank_error"] for q, c in zip(RANKS, ("p50", "p90", "p99", "p99_9"), strict=True))
    assert not groups
    assert _levels(64) == [] and _levels(4096) == [64] and _levels(800_000) == [12_500, 196, 4]
    for salts in (0, 3, [7, 2]):
        for r in quantiles(merge_sketches(by_day, ["k"], salts=salts), ["k"]).collect():
            own = whole[r.k]
            assert r.n == len(own) and off(own, 0.99, r.p99) <= r.p99_rank_error
    assert sketch_by(df.where("k = 99"), ["k"], "v").count() == 0


def test_packing_lengths():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 2049, 5000), rng.integers(1, 60, 5000), np.full(100, 2048), np.full(99, 1025), np.array([1]), np.array([], np.int64)):
        container, offset, tier, pack, context = pack_lengths(lengths)
        used = np.bincount(container, weights=lengths) if len(lengths) else np.array([])
        assert (used <= 2048).all() and (used > 0).all()
        for c in set(container[:200].tolist()):
            own = np.flatnonzero(container == c)
            own = own[np.argsort(offset[own])]
            assert (offset[own] == np.concatenate([[0], np.cumsum(lengths[own])[:-1]])).all() and len(set(tier[own])) == 1 and tier[own[0]] == context[own[0]]
            for k in set(pack[own]):  # a pack keeps to its own context, and its texts lie together
                inside = own[pack[own] == k]
                assert lengths[inside].sum() <= context[inside[0]] and len(set(context[inside])) == 1 and (np.diff(np.flatnonzero(pack[own] == k)) == 1).all()
                assert (lengths[inside] > {256: 0, 512: 256, 1024: 512, 2048: 1024}[context[inside[0]]]).all()
        if len(lengths) == 5000:
            assert lengths.sum() / (2048 * len(used)) > 0.98
            assert (container != pack_lengths(lengths, tiers=(2048,))[0]).mean() > 0.5  # not one best fit over all
    lengths = rng.integers(1, 2049, 4000)
    container, _, _, pack, _ = pack_lengths(lengths)
    groups = step_groups(container, pack, lengths)
    of_pack = defaultdict(int)
    for c, k, g, n in zip(container, pack, groups, lengths, strict=True):
        of_pack[c, k, g] += n
    work = defaultdict(int)
    for (_, _, g), n in of_pack.items():
        work[g] += int(n) ** 2
    assert max(work.values()) < 1.2 * min(work.values())
    with pytest.raises(ValueError, match="positive"):
        pack_lengths(lengths, tiers=(0, 2048))


def test_packing_texts(spark):
    long = "word " * 5000
    data = [(i, f"text number {i} " * (i % 40 + 1)) for i in range(300)] + [(300, long), (301, None), (302, ""), (None, "x"), (303, "same"), (303, "same"), (304, "a" * 30_000)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS tokens", "2 AS container", "3 AS part")
    counts = defaultdict(int)
    for r in token_counts(df, "doc_id", "text").collect():
        counts[r.id] += r.tokens
    got = pack(df).collect()
    total = defaultdict(int)
    fill = defaultdict(int)
    for r in got:
        total[r.doc_id] += r.tokens
        fill[r.container] += r.tokens
        assert r.parts == 1 or r.part == r.parts - 1 or r.tokens == 2048
    counts.pop(None)
    assert dict(total) == {k: v for k, v in counts.items() if v} and max(fill.values()) <= 2048
    assert {r.doc_id for r in got if r.parts > 1} == {k for k, v in counts.items() if v > 2048} >= {300}
    key = lambda rs: sorted((r.doc_id, r.part, r.tokens, r.container, r.container_offset, r.pack) for r in rs)
    assert key(got) == key(pack(df.repartition(5)).collect())
    shards = key(pack(df, shards=7).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    assert key(pack(df.repartition(5), shards=7).collect()) == shards  # whatever the partitions and batches
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    many = spark.range(9000).selectExpr("1L AS doc_id", "'same words' AS text")  # one row many times
    assert pack(many, shards=4).groupBy("container").count().count() >= 4 and pack(many, shards=4).count() == 9000
    assert pack(df.where("doc_id = 999")).count() == 0


def semi_global(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j - 1] + (c != d), row[j] + 1, now[-1] + 1))
        row = now
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        assert distance(a, b) == semi_global(a, b)
    assert distance("abc", "") == 3


ITEM = "The keeper of Lorana counts 418 lamps before dusk. Who carries the ladder from Tizeno to Bakuri? A red cart leaves Semola at 7:45 and returns with 93 barrels."
TASK = "Read the passage and answer the question."


def test_leaks(spark):
    half = ITEM[:92]
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM)
    docs = {
        1: f"Something else. {ITEM} And more.", 2: half, 3: ITEM[:60], 4: ITEM.upper().replace(".", "").replace(" ", "​ \n"), 5: wide, 6: ITEM.replace("lamps", "candles").replace("cart", "wagon"),
        7: "The keeper of Vimuta counts 902 lamps before dusk. Who carries the ladder from Gorebi to Nalime? A red cart leaves Pidavo at 9:10 and returns with 15 barrels.", 8: TASK, 9: None, 10: "", 11: "x " * 60_000 + ITEM,
        12: unicodedata.normalize("NFD", "Der große Müller aus Köln zählt 512 Säcke. Übermorgen fährt er nach Nürnberg zurück."), 13: "Lorana Tizeno Bakuri Semola 418 93",
    }
    items = [(1, f"{TASK}\n\n{ITEM}"), (2, f"{TASK}\n\nquite other words stand here about the price of rope in winter"), (3, TASK), (4, None), (5, "Der große Müller aus Köln zählt 512 Säcke. Übermorgen fährt er nach Nürnberg zurück."), (6, "")]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS share", "'w' AS wording")
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc", "'p' AS paragraph", "0 AS at")
    want = {(d, 1) for d in (1, 2, 4, 5, 6, 11)} | {(12, 5)}
    assert {(r.doc_id, r.item_id) for r in leaks(df, it).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leaks(df, it, block_letters=10).collect()} == want  # blocks of items
    assert leaks(df.where("doc_id = 99"), it).count() == 0 and leaks(df, it.where("item_id = 4")).count() == 0
    assert normal("Ａb-1­ c") == "ab1c"


UNITS = {
    "en": ["Mr. Lane (see p. 3) pays 4.50 at 7 p.m.", "“Is it ready? Come in!” says Ann to F. Bell.", "Tom asks: “Why 5? Why not 6?”", "She waits … but he goes...", "Wire, nails, etc.", "(It takes 5 minutes.)", "Version 2.4.1 runs as plan_3.txt."],
    "de": ["Dr. Haas zahlt ca. 3,5 Euro, d. h. wenig.", "„Komm! Geh nicht!“, sagt sie am 14. Juni zu ihm.", "Draht, Stoff usw.", "Das Haus gehört Lang & Co.", "Wer ist das?"],
    "fr": ["M. Roux paie env. 5 francs à Mme. Petit.", "« Pourquoi moi ? Viens ! » dit Anne à Luc.", "Quelle route !", "La porte reste fermée à 7 h env.", "Il arrive."],
    "es": ["La Sra. Paz mide aprox. 3 litros, p. ej. aceite.", "«¡Ven! ¿Por qué no?», dice Luis.", "La puerta se abre a las 7 p. m.", "¿Quién es?"],
    "ru": ["Проф. Ким платит прим. 5 руб. за п. 8 списка.", "«Слово верно. Приезжай!» — говорит Анна.", "Гвозди, ткань и т. д.", "Ворота открыты с 7 ч.", "Кто там?"],
    "el": ["Ο κ. Παππάς πληρώνει περ. 3,5 ευρώ.", "Τι θέλει στις 10:57;", "Το κλειδί μένει· η πύλη κλείνει.", "Καρφιά, σύρμα κ.λπ."],
    "hi": ["डॉ. राम 3.5 लीटर नापता है।", "“पुल तैयार है। आओ!” वह कहता है।", "वह पूछता है: “क्यों? कब?”", "वह जाता है."],
    "ar": ["يقيس د. سامي نحو 3.5 لترا.", "«الباب جاهز. تعال!» يقول سامي.", "من يعرف سامي؟", "يفتح الباب في 7 م."],
}


@pytest.mark.parametrize("lang", UNITS)
def test_units(lang):
    for gap in (" ", "\n", "  "):
        text = f" {gap.join(UNITS[lang])} \n\n Head: one 12 \n \n{UNITS[lang][0]}"
        assert [text[s:e] for s, e in split(text, "xx")] == [*UNITS[lang], "Head: one 12", UNITS[lang][0]]


def test_units_without_spaces():
    zh = ["按No. 117，他付64.8元。", "“准备好了。快来！”他说。", "他问：“为什么？”", "想了想……然后说是桥．", "（见第3页。）"]
    assert [("".join(zh))[s:e] for s, e in split("".join(zh))] == zh
    ja = ["彼は「なぜ？いつ？」と聞く。", "表のNo. 5により払う｡", "（3分ほどかかる。）", "橋か！"]
    assert [("".join(ja))[s:e] for s, e in split("".join(ja))] == ja
    th = ["ดร. โนวัดน้ำมันได้ 8.5 ลิตรใกล้นา", "เขาถามว่า“ทำไม 5 ทำไมไม่” แต่เธอเงียบ", "มีลวดต่าง ๆ อยู่ข้างใน"]
    assert [(" ".join(th))[s:e] for s, e in split(" ".join(th))] == th


def test_units_awkward(spark):
    data = [(1, None, "en"), (2, "", None), (3, " \n\n ", "en"), (4, "No end here", "en"), (5, "“Cut off. And on", None), (6, "A bird. " * 25_000, "en"), (None, "One.", "en"), (7, "😀 One. Two.", "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "2 AS unit", "3 AS start_char")
    got = defaultdict(list)
    for r in sentences(df).collect():
        got[r.doc_id].append((r.start_char, r.end_char, r.unit))
    assert got[4] == [(0, 11, "No end here")] and got[5] == [(0, 16, "“Cut off. And on")] and got[None] == [(0, 4, "One.")]
    assert sorted(got[7]) == [(0, 6, "😀 One."), (7, 11, "Two.")] and len(got[6]) == 25_000
    assert not {1, 2, 3} & set(got)


def test_units_of_long_texts():
    """Time grows with the length only, and no part of a text is judged by another part far away."""
    began = time.perf_counter()
    quoted = "“The letter is ready. Come in!” says Ann. "
    assert len(split(quoted * 16_000)) == 16_000
    assert len(split("(" * 50_000 + " One ends. Two ends." + "“" * 50_000)) >= 1 and len(split("A.B." * 50_000)) == 1
    assert len(split("ก ข " * 20_000, "th")) == 40_000
    assert time.perf_counter() - began < 20
    en, de = "According to no. 5 of the list he pays the sum to her and goes.", "Das kommt von dem 3. Januar und ist nicht gut, z. B. für den Mann."
    text = f"{' '.join([en] * 400)}\n\n{' '.join([de] * 2000)}"
    assert len(split(text, "en")) == 2400 and len(split(text, None)) == 2400
    assert languages_of([en * 400, de * 2000, "Ann Roux"], "fr") == ["en", "de", "de"]


def test_units_of_open_quotations():
    assert len(split("“An open mark. " + "One sentence here. " * 50)) == 51
    assert split("“Cut off. And on") == [(0, 16)] and len(split("He says: “Why? Now” and goes. Then “no. And")) == 2


def test_units_with_invisible_characters():
    text = "Mr\u00ad. Lane pays. He goes\u200b. \u200bOn."
    assert [text[s:e] for s, e in split(text, "en")] == ["Mr\u00ad. Lane pays.", "He goes\u200b.", "On."]
