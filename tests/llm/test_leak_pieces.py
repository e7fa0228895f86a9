"""Leaks that stand or fall with the pieces that are searched."""

import random

import numpy as np
import pytest

from weftline.llm.leakage import CHANGED, Block, Plan, any_within, budget, distance, leaks, normal

ITEM = "The keeper of Lorana counts 418 lamps before dusk. Who carries the ladder from Tizeno to Bakuri? A red cart leaves Semola at 7:45 and returns with 93 barrels."


def found(spark, docs, items, **options):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in leaks(df, it, **options).collect()}


def test_items_of_one_pattern(spark):
    """Every piece stands in three or more items; a document that holds one whole is still found."""
    items = [(k, f"The ferry waits below the old mill until the last of the {n} carters has paid the keeper in copper.") for k, n in enumerate((418, 902, 637, 755, 281), 1)]
    docs = {1: f"Seen today. {items[0][1]} More follows.", 2: "Nothing of it stands here."}
    whole = found(spark, docs, items)
    assert (1, 1) in whole and not any(d == 2 for d, _ in whole)
    assert found(spark, docs, items, block_letters=10) == whole == found(spark, docs, items, block_letters=250)
    assert found(spark, docs, items[:1]) == {(1, 1)}


def test_the_same_item_many_times(spark):
    """An item in several collections is reported of each of them, also with an instruction before it."""
    task = "Read the passage and answer the question."
    items = [(1, ITEM), (2, ITEM), (3, ITEM), (4, f"{task}\n\n{ITEM}"), (5, f"{task}\n\nquite other words stand here about rope"), (6, f"{task}\n\nand nothing of that kind is in this one")]
    assert found(spark, {1: f"Here: {ITEM}", 2: task}, items) == {(1, 1), (1, 2), (1, 3), (1, 4)}


def words(rng, n):
    return ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) if i % 20 else str(rng.randrange(100, 10**5)) for i in range(n)]


@pytest.mark.parametrize(("n", "every"), [(250, 15), (500, 25), (250, 8)])
def test_long_items_with_replaced_words(spark, n, every):
    rng = random.Random(n + every)
    item, fresh = words(rng, n), words(rng, n)
    held = [fresh[i] if i % every == every // 2 else w for i, w in enumerate(item)]
    docs = {1: " ".join(held), 2: " ".join(held[n // 2 - 5 :]), 3: " ".join(held[: n // 3]), 4: " ".join(fresh), 5: "before " * 300 + " ".join(held) + " after" * 300, 6: "x " * 250_000 + " ".join(held)}
    assert found(spark, docs, [(1, " ".join(item)), (2, "quite other words stand here about the price of rope in winter")]) == {(1, 1), (2, 1), (5, 1), (6, 1)}


def test_recall_by_replaced_words():
    """Every draw within the edits allowed is found; beyond them the share falls off."""
    rng = random.Random(1)
    block = Block([(1, ITEM)])
    own, plain = normal(ITEM), ITEM.split()
    share: dict[int, float] = {}
    for n in range(9):
        hit = inside = lost = 0
        for _ in range(60):
            held = list(plain)
            for i in rng.sample([k for k, w in enumerate(plain) if not any(c.isdigit() for c in w)], n):
                held[i] = words(rng, 2)[1]
            text = normal("some words " + " ".join(held) + " follow it")
            got = bool(block.found([text]))
            hit += got
            if distance(own, text) <= budget(len(own)) and n <= CHANGED * len(plain):
                inside += 1
                lost += not got
        share[n] = hit / 60
        assert lost <= 0.1 * inside
    # Words of six letters or so for words of any length: four take about the edits allowed, eight are far beyond them.
    assert all(share[n] == 1.0 for n in range(4)) and share[4] >= 0.9 and share[8] < share[6] < share[4], share


def test_pieces_outnumber_the_changes():
    """With any words replaced, up to the limit, a stretch keeps the pieces that a case needs."""
    rng = random.Random(2)
    for n in (12, 29, 60, 200):
        for text in (" ".join(words(rng, n)), "".join(chr(rng.randrange(0x4E00, 0x6E00)) for _ in range(3 * n))):
            plan = Plan(text, 0.5)
            starts = [i for i, c in enumerate(text) if not i or text[i - 1] == " "] if " " in text else list(range(len(text)))
            at = [len(normal(text[:i])) for i in starts] + [len(plan.letters)]
            for _ in range(200):
                a = rng.randrange(len(plan.letters) - plan.shortest + 1)
                b = rng.randrange(a + plan.shortest, len(plan.letters) + 1)
                units = [k for k in range(len(starts)) if at[k] < b and at[k + 1] > a]
                changed = rng.sample(units, int(CHANGED * len(units)))
                kept = [p for p in plan.pieces if a <= p[0] and p[1] <= b and not any(at[k] < p[1] and at[k + 1] > p[0] for k in changed)]
                assert len(kept) >= plan.need


def test_any_of_many_within():
    rng = random.Random(3)
    for words_ in (1, 2, 3):
        lanes, masks, texts, want = [], [], [], []
        alphabet = "abc"
        rows = 0
        for k in range(200):
            m = rng.randrange(64 * words_ - 63, 64 * words_ + 1)
            pattern = "".join(rng.choice(alphabet) for _ in range(m))
            text = "".join(rng.choice(alphabet + "x") for _ in range(rng.randrange(1, 90)))
            if k % 3 == 0:
                text = text[:20] + "".join(c if rng.random() > 0.1 else rng.choice(alphabet) for c in pattern) + text[20:]
            edits = rng.randrange(max(1, m // 2))
            own = np.zeros((4, words_), np.uint64)
            for i, c in enumerate(pattern):
                own[alphabet.index(c) + 1, i // 64] |= np.uint64(1 << i % 64)
            lanes.append((rows, k, m, edits))
            masks.append(own)
            rows += 4
            texts.append([alphabet.find(c) + 1 for c in text])
            want.append(distance(pattern, text) <= edits)
        letters = np.zeros((200, max(map(len, texts))), np.int64)
        for k, t in enumerate(texts):
            letters[k, : len(t)] = t
        assert any_within(lanes, np.concatenate(masks), letters).tolist() == want
