"""``all_leaks`` against its rules in plain Python, and long items of many slots."""

import random
import time
from collections import Counter, defaultdict

import pytest
import regex

from panelforge.llm import decontam

WORDS = "the farmer sells cows at every market and buys sheep near river".split()
SLOTS = ["3", "4", "5", "12", "Maria", "Peter", "Anna", "kg", "days"]


def bare_of(word):
    return word.strip(decontam.MARKS)


def template(text):
    words, out = [w for w in regex.split(r"[\x20\x09-\x0D]+", text) if w], []
    for k, w in enumerate(words):
        before, bare = words[k - 1] if k else None, bare_of(w)
        if regex.search(r"^[-+$€£#]?\p{Nd}[\p{Nd}.,:/]*%?$", bare):
            out.append((k, "<num>", bare.lower()))
        elif bare in decontam.UNITS and regex.search(r"\p{Nd}[.,]?$", before or ""):
            out.append((k, "<unit>", bare.lower()))
        elif regex.search(r"^\p{Lu}[\p{Ll}'’-]+$", bare) and regex.search(r"[^.!?:;|>\"]$", before or "."):
            out.append((k, "<name>", bare.lower()))
        elif bare:
            out.append((k, bare.lower(), None))
    return out


def plain(text):
    marked = [(k, regex.sub(r"[\p{P}\p{S}]+", "", w.lower()), None) for k, w in enumerate(w for w in regex.split(r"[\x20\x09-\x0D]+", text) if w)]
    return [x for x in marked if x[1]]


def streams(text):
    t, p = template(text), plain(text)
    return {"t": t} if [x[1] for x in t] == [x[1] for x in p] else {"t": t, "p": p}


def windows(stream, size):
    n = len(stream)
    return [(k, stream[k : k + size]) for k in range(n) if n - k >= size or (k == 0 and 0 < n < size)]


def brute(texts, items, size=decontam.WINDOW, share=decontam.LEAST_SHARE, run=decontam.RUN_WORDS):
    """(doc, item) -> n_windows, n_matched, reparameterised, for unique ids."""
    out = {}
    for item, item_text in enumerate(items):
        wanted, n_windows = {}, Counter()
        for kind, stream in streams(item_text).items():
            kept = [w for w in windows(stream, size) if kind == "p" and len(w[1]) == size or kind == "t" and sum(x[2] is None for x in w[1]) >= min(decontam.LEAST_LITERALS, len(w[1]))]
            wanted[kind] = [(pos, rank, w) for rank, (pos, w) in enumerate(kept)]
            n_windows[kind] = len(kept)
        n = n_windows["t"] or n_windows["p"]
        towards = {w[0][0] for _, _, w in wanted["t"]}
        for doc, text in enumerate(texts):
            lines = defaultdict(list)
            for kind, stream in streams(text).items():
                for pos, d in windows(stream, size):
                    for item_kind in wanted:
                        for item_pos, rank, i in wanted[item_kind]:
                            if [x[1] for x in i] == [x[1] for x in d]:
                                pairs = [(a[2], b[2]) for a, b in zip(i, d) if a[2] is not None and b[2] is not None]
                                lines[kind, item_kind, pos - item_pos].append((item_pos, rank, i[0][0], pairs))
            strict, places, longest, strict_changed, changed = set(), set(), 0, False, False
            for (kind, item_kind, _), found in lines.items():
                tally = Counter(p for *_, pairs in found for p in pairs)
                best = {a: max((c, a == y, y) for (x, y), c in tally.items() if x == a)[2] for a, _ in tally}
                kept = [w for w in found if all(a == b for a, b in w[3]) or all(best[a] == b for a, b in w[3])]
                if kind == item_kind == "t" and len(tally) == len({a for a, _ in tally}) == len({b for _, b in tally}):
                    strict |= {w[0] for w in found}
                    strict_changed |= any(a != b for a, b in tally)
                places |= {w[2] for w in kept if not towards or w[2] in towards}
                changed |= any(a != b for w in kept for a, b in w[3])
                ranks = {w[1] for w in kept}
                longest = max([longest, *(next(k for k in range(1, len(ranks) + 2) if r + k not in ranks) for r in ranks)])
            if n and (len(strict) / n >= share):
                out[doc, item] = (n, len(strict), strict_changed)
            elif n and (len(places) / n >= share or longest >= run - size + 1):
                out[doc, item] = (n, len(places), changed)
        words = [x[1] for x in plain(item_text)]
        if len(template(item_text)) < size and 1 <= len(words) < size:
            for doc, text in enumerate(texts):
                own = [x[1] for x in plain(text)]
                if any(own[k : k + len(words)] == words for k in range(len(own) - len(words) + 1)):
                    out.setdefault((doc, item), (1, 1, False))
    return out


def random_text(r, least, most):
    return " ".join(r.choice(SLOTS) if r.random() < 0.35 else r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(least, most)))


def swapped(r, text):
    """``text`` with some slots of one kind given other values, in part consistently."""
    new = {s: r.choice(SLOTS[:4] if s.isdigit() else SLOTS[4:7]) for s in SLOTS[:7]}
    return " ".join((new[w] if r.random() < 0.9 else r.choice(SLOTS[:4])) if w in new else w for w in text.split(" "))


@pytest.mark.parametrize("seed", [1, 2])
def test_all_leaks_against_brute_force(spark, seed):
    r = random.Random(seed)
    items = [random_text(r, 1, 30) for _ in range(25)] + ["a tiny item", "12 3 4 5 12 3", "", "3", *["the cows, the cows, the cows, the cows, the cows"] * 2]
    texts = ["", "a tiny item", "the cows " * 12]
    for _ in range(70):
        item = r.choice(items)
        part = item.split(" ")
        at = r.randint(0, max(len(part) - 14, 0))
        same = r.choice([item, swapped(r, item), item.upper(), swapped(r, swapped(r, item)), " ".join(part[at : at + r.randint(6, 16)])])
        texts.append(f"{random_text(r, 0, 8)} {same} {random_text(r, 0, 8)}")
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), None), (None, items[0])], "doc_id long, text string")
    benchmark = spark.createDataFrame([*enumerate(items), (len(items), None), (None, texts[5])], "item_id long, text string")
    want = brute(texts, items)
    got = {(x.doc_id, x.item_id): (x.n_windows, x.n_matched, x.reparameterised) for x in decontam.all_leaks(docs, benchmark).collect()}
    assert got == want and len(want) > 40 and any(v[2] for v in want.values())


def test_long_item_of_many_slots(spark):
    """A document equal to an item of 20,000 words, every second one a number, is found in seconds."""
    text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} {k}" for k in range(10_000))
    docs = spark.createDataFrame([(1, text), (2, "nothing of it")], "doc_id long, text string")
    began = time.perf_counter()
    (row,) = decontam.all_leaks(docs, spark.createDataFrame([(7, text)], "item_id long, text string")).collect()
    assert (row.doc_id, row.item_id, row.n_windows, row.n_matched, row.reparameterised) == (1, 7, 19_996, 19_996, False)
    assert time.perf_counter() - began < 120
