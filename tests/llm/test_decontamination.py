"""Decontamination against a matcher written word for word, and against planted re-parameterised items."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from glintframe.llm import decontaminate as D

WORDS = "the of and water river stone paper glass train station market garden winter summer letter window bridge flour sugar bottle pencil carpet ladder basket teacher doctor farmer painter walks carries builds paints counts leaves finds brings every other before after during under until about between along".split()
NAMES = "Alice Bob Carla Dieter Emma Felix Greta Hannah Igor Julia Karl Lena".split()


def item(rng: random.Random, i: int) -> str:
    words = [rng.choice(WORDS) for _ in range(rng.randrange(14, 34))]
    for name in rng.sample(NAMES, 2):
        words.insert(rng.randrange(2, len(words)), name)
    for n in rng.sample(range(2, 900), 4):
        words.insert(rng.randrange(1, len(words)), str(n))
    return " ".join(words)


def renumbered(rng, text):
    new = {}
    taken = rng.sample(range(1000, 9000), 40)
    return re.sub(r"\d+", lambda m: str(new.setdefault(m.group(), taken[len(new)])), text)


def renamed(rng, text):
    for a, b in zip([w for w in text.split() if w in NAMES], ("Mary Ann", "Oskar"), strict=True):
        text = re.sub(rf"\b{a}\b", b, text)
    return text


def shared_value(rng, text):
    a, b = re.findall(r"\d+", text)[:2]
    return re.sub(rf"\b{a}\b", b, text)  # one value becomes another of the item's, which stays


def inserted(rng, text):
    words = renumbered(rng, text).split()
    words.insert(rng.randrange(4, len(words) - 4), "very")
    return " ".join(words)


def verbatim(rng, text):
    return text


KINDS = (renumbered, renamed, shared_value, inserted, verbatim)


def planted(seed: int):
    rng = random.Random(seed)
    items = {i: item(rng, i) for i in range(40)}
    items[100] = "12 + 7 = 19 and 3 x 4 = 12"
    items[101] = "solve 31 plus 5 minus 8 times 2 then add 7"
    filler = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(10, 60)))
    docs, want = {}, {}
    for i, text in items.items():
        for kind in KINDS if i < 100 else (renumbered, verbatim):
            want[len(docs)] = (i, kind.__name__)
            docs[len(docs)] = f"{filler()} {kind(rng, text)} {filler()}"
    for _ in range(150):
        docs[len(docs)] = f"{filler()} {rng.randrange(900)} {filler()} {rng.choice(NAMES)} {filler()}"
    return items, docs, want


def number(core: str) -> bool:
    return core.lower() in D.NUMBER_WORDS or D.NUMBER.fullmatch(core) is not None


def brute_windows(text: str):
    """(mode, words of the windows by position, slots), from the definitions."""
    raw = []
    for chunk in text.split():
        core = D.TRIM.sub("", chunk)
        if core:
            raw.append((core, bool(D.SENTENCE_END.search(chunk)), chunk))
    tokens, before_end = [], True
    for k, (core, ends, _) in enumerate(raw):
        if number(core):
            kind = "N"
        elif core.lower() in D.UNITS and k and number(raw[k - 1][0]):
            kind = "U"
        elif core[0].isupper():
            kind = "P"
        else:
            kind = ""
        tokens.append((kind, core.lower(), before_end))
        before_end = ends
    merged = []
    for kind, value, opens in tokens:
        if kind == "P" and not opens and merged and merged[-1][0] == "P":
            merged[-1] = ("P", merged[-1][1] + " " + value, merged[-1][2])
        else:
            merged.append((kind, value, opens and kind == "P"))
    return merged, [("", v, False) for _, v, _ in tokens]


def brute(items: dict, docs: dict) -> set:
    found = set()
    for i, text in items.items():
        for mode, of in enumerate(brute_windows(text)):
            if not of:
                continue
            width = min(D.WINDOW, len(of))
            cut = lambda t: [tuple(("", v) if not k else (k, "") for k, v, _ in t[p : p + width]) for p in range(len(t) - width + 1)]
            mine = cut(of)
            informative = [any(not k for k, _ in w) for w in mine]
            for d, doc in docs.items():
                other = brute_windows(doc)[mode]
                places = defaultdict(list)
                for q, w in enumerate(cut(other)):
                    places[w].append(q)
                hits = sorted((q - p, p, q) for p, w in enumerate(mine) if informative[p] for q in places[w])
                chains, last = [], None
                for shift, p, q in hits:
                    if last is None or shift - last > D.SLACK:
                        chains.append([])
                    last = shift
                    chains[-1].append((p, q))
                for chain in chains:
                    at = {p for p, _ in chain}
                    covered = len({p + k for p in at for k in range(width)})
                    share, cover = (D.LEAST_SHARE, D.LEAST_COVER) if mode == 0 else (D.LITERAL_SHARE, D.LITERAL_COVER)
                    if not (len(at) / sum(informative) >= share or covered >= cover * len(of)):
                        continue
                    if mode == 0:
                        pairs = {(of[p + k][1], other[q + k][1]) for p, q in chain for k in range(width) if of[p + k][0]}
                        changed = {x for x in pairs if x[0] != x[1]}
                        n = len({a for a, _ in pairs})
                        telling = {of[p + k][1] for p, q in chain for k in range(width) if of[p + k][0] and not (of[p + k][2] and of[p + k][1] == other[q + k][1])}
                        broken = len(pairs) - n + len(changed) - len({b for _, b in changed})
                        strong = any(sum(not k for k, _ in mine[p]) >= min(D.LEAST_WORDS, width) for p in at)
                        if (broken and broken >= D.BROKEN * len(telling)) or not (strong or len(at) > 1):
                            continue
                    found.add((d, i))
    return found


def test_planted_items_are_found_as_by_brute_force(spark):
    items, docs, want = planted(3)
    rows = D.matches(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got == brute(items, docs)
    caught = defaultdict(list)
    for d, (i, kind) in want.items():
        caught[kind].append((d, i) in got)
    assert all(sum(c) >= 0.9 * len(c) for c in caught.values()), {k: sum(c) / len(c) for k, c in caught.items()}
    assert all(d in want for d, _ in got)
    exact = {(r.doc_id, r.item_id) for r in rows if r.exact}
    assert exact == {(d, i) for d, (i, kind) in want.items() if kind == "verbatim"}


PROBLEMS = """{a} has {x} apples. {a} buys {y} more. {a} eats {z}. How many apples are left?
{a} has {x} red pens. {a} has {y} blue pens. How many pens are there?
{a} walks {x} km to the market. {b} walks {y} km. How far do both walk together?
{b} sells {x} tickets on Monday. {b} sells {y} tickets on Tuesday. How many tickets in all?
{a} is {x} years old. {b} is {y} years older. How old will {b} be in {z} years?
{a} reads {x} pages a day. The book has {y} pages. How many days does {a} need?
{a} and {b} share {x} marbles. {a} takes {y}. How many marbles does {b} get?
A train leaves at {x} with {y} people. {z} people get off. How many stay?
{b} fills {x} bottles with {y} litres each. {b} spills {z} litres. How much is left?
{a} earns {x} dollars. {a} spends {y} dollars on a bike. {a} saves the rest. How much is it?
Every box holds {x} eggs. {a} packs {y} boxes. {b} breaks {z} eggs. How many are whole?
{a} plants {x} trees in spring. {b} plants {y} trees in autumn. How many trees grow?""".splitlines()
CLEAN = """{a} has {x} cousins in the north. {a} visits them every summer. They swim a lot.
{a} buys a red coat. {b} buys {y} buttons for it. The coat is warm.
{b} sells the house by the river. {b} moves to town with {x} cats.
{a} walks home. {b} walks {y} dogs for the neighbours. The dogs bark at night.
{a} is a teacher. {b} is {y} years into the job. Both like the school.
{a} reads a letter. The letter has {y} stamps. {b} collects stamps.
{a} and {b} share a room. {a} takes the bed. {b} takes the floor.
The train to town leaves soon. {b} packs {x} bags. {a} waits outside.
{a} earns little. {a} spends evenings in the library. {b} works {x} nights.""".splitlines()


def spoken(rng: random.Random, form: str) -> str:
    a, b = rng.sample(["Tom", "Mia", "Bob", "Zoe", "Ann Marie", "Omar", "Ilse", "Pavel", "Kim"], 2)
    x, y, z = rng.sample(range(2, 200), 3)
    return form.format(a=a, b=b, x=x, y=y, z=z)


def test_names_that_open_sentences(spark):
    rng = random.Random(8)
    items = {i: spoken(rng, form) for i, form in enumerate(PROBLEMS)}
    docs, want = {}, {}
    around = lambda: spoken(rng, rng.choice(CLEAN))
    for i, form in enumerate(PROBLEMS):
        for _ in range(5):
            want[len(docs)] = i
            docs[len(docs)] = f"{around()} {spoken(rng, form)} {around()}"
    for _ in range(300):
        docs[len(docs)] = " ".join(around() for _ in range(rng.randrange(1, 6)))
    rows = D.matches(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(got & set(want.items())) >= 0.9 * len(want), sorted(set(want.items()) - got)
    assert all(d in want for d, _ in got), [docs[d] for d, _ in got if d not in want]
