import random
import re

from tests.llm.helpers import ODD, docs
from trustloom.llm import decontaminate as d

ITEMS = [
    (1, "Alice has 12 apples and gives 5 kg of the heavy fruit to her friend Bob before Alice walks back home with the rest of them all"),
    (2, "which of these small rivers flows through the old capital before it reaches the wide northern sea near the harbour town"),
    (3, "too short to run"),
    (4, None), (5, ""),
]


def found(spark, texts, items=ITEMS):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in d.leaks(docs(spark, texts), bench).collect()}


def brute_tokens(text):
    out = []
    for m in re.finditer(r"(?:[^\W_]|(?<=\d)[.,](?=\d))+", text or ""):
        w = m[0]
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
        kind = d.NUMBER if re.fullmatch(r"[0-9.,]+", w) or low in d.NUMBER_WORDS else d.UNIT if low in d.UNITS else d.NAME if re.match("[A-ZÀ-ÖØ-Þ]", w) else d.WORD
        out.append((kind, low))
    return out


def brute(texts, items):
    """Longest consistent run over all alignments, token by token."""
    out = set()
    for doc, text in enumerate(texts):
        a = brute_tokens(text)
        for item, said in items:
            b = brute_tokens(said)
            if not b:
                continue
            size = min(d.WINDOW, len(b))
            need = min(d.LITERALS, max(1, size - (d.WINDOW - d.LITERALS)))
            if size < d.WINDOW and len(a) != len(b):
                continue
            same = lambda x, y: x[0] == y[0] and (x[0] != d.WORD or x[1] == y[1])
            for shift in range(-len(b), len(a) + 1):
                covered = set()
                for p in range(max(0, shift), len(a) - size + 1):
                    q = p - shift
                    if 0 <= q <= len(b) - size and all(same(a[p + k], b[q + k]) for k in range(size)) and sum(a[p + k][0] == d.WORD for k in range(size)) >= need:
                        covered.update(range(p, p + size))
                length, there, back, last = 0, {}, {}, None
                for p in sorted(covered):
                    if last is not None and p != last + 1:
                        length, there, back = 0, {}, {}
                    last = p
                    x, y = a[p], b[p - shift]
                    if x[0] != d.WORD:
                        if there.get(y, x) != x or back.get(x, y) != y:
                            length, there, back = 0, {}, {}
                        there[y], back[x] = x, y
                    length += 1
                    if length >= min(d.RUN, len(b)):
                        out.add((doc, item))
    return out


def test_reparameterised_items_are_found(spark):
    one = ITEMS[0][1]
    other = one.replace("Alice", "Zoé").replace("Bob", "Tariq").replace("12", "1,250.5").replace(" 5 kg", " 70 lbs")
    mixed = one.replace("Alice", "Zoe", 1).replace("Bob", "Tariq").replace("kg", "lbs")
    got = found(spark, [f"Some text before. {one}. And after.", other, mixed, ITEMS[1][1][:95].upper(), ITEMS[1][1].replace("of", "off").replace("old", "odd").replace("wide", "wild"), "too short to run", "it is too short to run", *ODD])
    assert set(got) >= {(0, 1), (1, 1), (5, 3)} and (4, 2) not in got and (6, 3) not in got
    assert got[0, 1].exact and not got[1, 1].exact and got[1, 1].n_matched >= 26
    # Zoe where the item has Alice, and Alice again where it has Alice: no one filling
    assert (2, 1) not in got or got[2, 1].n_matched < got[2, 1].n_item


def test_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    pool = ["the", "of", "river", "Paris", "Rome", "Été", "7", "12.5", "km", "three", "walks", "home", "old", "blue", "été", "a1"]
    items = [(k, " ".join(rnd.choices(pool, k=rnd.choice([2, 5, 8, 14, 30])))) for k in range(25)]
    texts = []
    for k in range(120):
        words = rnd.choices(pool, k=rnd.randint(0, 20)) + rnd.choice(items)[1].split()[: rnd.randint(5, 40)] + rnd.choices(pool, k=rnd.randint(0, 9))
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(pool)
        texts.append(rnd.choice([" ", "  ", ", ", ".\n"]).join(words))
    texts += [t for _, t in items[:6]]
    want = brute(texts, items)
    assert set(found(spark, texts, items)) == want and want
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    assert set(found(spark, texts, items)) == want


def test_no_rows(spark):
    assert found(spark, []) == {} == found(spark, ["a b c"], [(1, None)])


def test_copies_in_any_case_are_found(spark):
    names = "Anna Bruno Carla Dario Elena Fabio Greta Hugo Irene Jonas Karin Lars Maria Nils"
    items = [(1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, names)]
    texts = [ITEMS[1][1].upper(), f"so {ITEMS[0][1].lower()} then", f"with {names} and others", names.lower(), ITEMS[1][1].title(), ITEMS[0][1][:60].upper() + ITEMS[0][1][60:]]
    got = found(spark, texts, items)
    assert set(got) == {(0, 2), (1, 1), (2, 3), (3, 3), (4, 2), (5, 1)} and all(r.exact and r.n_matched == r.n_item for r in got.values())
    items = [(7, "Éai éonleeau pour an éonqueê aivi ai große éenaitreoiaux Москва éoiré anvitre èenreré être là")]
    assert set(found(spark, [items[0][1].upper(), "so " + items[0][1].lower() + " là", "été"], items)) == {(0, 7), (1, 7)}


def brute_sub_runs(texts, items):
    """Longest consistent run over all alignments and all sub-runs of what windows of either sort cover."""
    out = {}
    for doc, text in enumerate(texts):
        a = [(k, w.lower()) for k, w in brute_tokens(text)]
        for item, said in items:
            b = [(k, w.lower()) for k, w in brute_tokens(said)]
            size = min(d.WINDOW, len(b))
            if not b or (size < d.WINDOW and len(a) != len(b)):
                continue
            need = min(d.LITERALS, max(1, size - (d.WINDOW - d.LITERALS)))
            for shift in range(-len(b), len(a) + 1):
                covered = set()
                for p in range(max(0, shift), min(len(a), len(b) + shift) - size + 1):
                    x, y = a[p : p + size], b[p - shift : p - shift + size]
                    shape = all(i[0] == j[0] and (i[0] != d.WORD or i == j) for i, j in zip(x, y)) and sum(i[0] == d.WORD for i in x) >= need
                    if shape or [w for _, w in x] == [w for _, w in y]:
                        covered.update(range(p, p + size))
                for begin in covered:
                    there, back, p = {}, {}, begin
                    while p in covered:
                        kind, own = b[p - shift]
                        if kind != d.WORD and (there.setdefault((kind, own), a[p][1]) != a[p][1] or back.setdefault((kind, a[p][1]), own) != own):
                            break
                        p += 1
                    out[doc, item] = max(out.get((doc, item), 0), p - begin)
    return {k: n for k, n in out.items() if n >= min(d.RUN, len(brute_tokens(dict(items)[k[1]])))}


def test_runs_go_on_behind_the_conflicting_slot(spark):
    words = "which of these small rivers flows past old stones before it meets that wide cold sea near our quiet harbour town again".split()
    words[1] = words[12] = "3"
    one = dict(enumerate(words))
    texts = [" ".join((one | {1: "5", 12: "7"}).values()), " ".join((one | {1: "5", 12: "5"}).values())]
    got = found(spark, texts, [(1, " ".join(words))])
    assert got[0, 1].n_matched == len(words) - 2 and got[1, 1].n_matched == len(words)
    two = " ".join((one | {1: "8"}).values())
    assert found(spark, [" ".join((one | {1: "5", 12: "5"}).values())], [(1, two)])[0, 1].n_matched == len(words) - 2


def test_equals_brute_force_of_all_sub_runs(spark):
    rnd = random.Random(16)
    pool = ["the", "of", "river", "Paris", "Rome", "Été", "7", "12.5", "km", "three", "walks", "home", "old", "blue", "été", "a1"]
    items = [(k, " ".join(rnd.choices(pool, k=rnd.choice([2, 5, 8, 14, 30])))) for k in range(20)]
    texts = []
    for _ in range(100):
        words = rnd.choices(pool, k=rnd.randint(0, 12)) + rnd.choice(items)[1].split()[: rnd.randint(5, 40)] + rnd.choices(pool, k=rnd.randint(0, 9))
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = rnd.choice(pool)
        texts.append(rnd.choice([str, str.upper, str.lower])(" ".join(words)))
    want = brute_sub_runs(texts, items)
    assert {k: r.n_matched for k, r in found(spark, texts, items).items()} == want and want
