import random
import re

import messy
import pytest
from compare import assert_same

from quern.llm import substring

WORD = re.compile(r"[0-9a-z_\u0080-\U0010ffff]+")


def brute(texts, unit="line", words=substring.MIN_WORDS, passage=substring.MIN_PASSAGE):
    """Removed (start, end) and the text left of each document, with plain loops over whole strings."""
    units = []
    for i, t in texts.items():
        lines = re.finditer(r"[^\n]*\n|[^\n]+" if unit == "line" else r"(?s).*?\n\n+|.+", t)
        for m in lines:
            w = WORD.findall(m[0].lower())
            if len(w) >= words:
                units.append((i, m.start(), m.end(), ("line", tuple(w))))
        phrases = [(m.start(), m.end(), w) for m in re.finditer(r"[^.,;:!?|\n]*[.,;:!?|\n]|[^.,;:!?|\n]+", t) if (w := WORD.findall(m[0].lower()))]
        for a in range(len(phrases)):
            w = []
            for b in range(a, len(phrases)):
                w += phrases[b][2]
                if len(w) >= passage:
                    units.append((i, phrases[a][0], phrases[b][1], ("run", tuple(w))))
                    break
    seen, gone = set(), {i: set() for i in texts}
    for i, a, z, key in sorted(units, key=lambda u: u[:2]):
        if key in seen:
            gone[i] |= set(range(a, z))
        seen.add(key)
    out = {}
    for i, t in texts.items():
        holes = [(m.start(), m.end()) for m in re.finditer("x+", "".join("x" if k in gone[i] else "." for k in range(len(t))))]
        out[i] = ("".join(c for k, c in enumerate(t) if k not in gone[i]), holes)
    return out


def texts(seed):
    rng = random.Random(seed)
    vocab = ["Ünder", "the", "über", "Ça", "fox", "dog", "é", "x_1", "42", "Straße", "bird", "AND"]
    lines = [" ".join(rng.choice(vocab) for _ in range(rng.choice([2, 7, 8, 12, 30]))) for _ in range(25)]
    lines = [re.sub(r"(\w+ \w+ \w+) ", lambda m: m[1] + rng.choice([" ", ", ", ". ", " | ", "! "]), x) for x in lines]
    out = {}
    for i in range(30):
        parts = []
        for _ in range(rng.randrange(6)):
            x = rng.choice(lines)
            parts.append(x.upper() if rng.random() < 0.2 else "in the " + x + " more" if rng.random() < 0.4 else x)
        out[i] = rng.choice(["\n", "\n\n", "\n\n\n"]).join(parts)
    return out


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_against_brute_force(spark, unit):
    held = texts(7)
    d = spark.createDataFrame(list(held.items()), "doc_id long, text string")
    rows = substring.dedup_units(d, unit=unit).collect()
    got = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in rows}
    want = brute(held, unit)
    assert got == want and sum(len(h) for _, h in want.values()) >= 8
    assert all(r.n_removed == len(r.removed) for r in rows)


def test_query_same_as_sql(spark, sf):
    assert_same(substring.op4(spark, sf), substring.OP4_SQL, sf)


def test_a_passage_in_the_middle_of_lines(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" + ("," if rng.random() < 0.2 else "") for _ in range(n))
    passage = say(60)
    d = messy.table(spark, say(30) + " " + passage + " " + say(30), say(40) + " " + passage + " " + say(9), say(80))
    rows = substring.dedup_units(d).orderBy("doc_id").collect()
    assert [r.n_removed for r in rows] == [0, 1, 0]
    (a, z), = rows[1].removed
    whole = d.where("doc_id = 1").first().text
    at = whole.index(passage)
    assert at <= a + 1 and z <= at + len(passage) + 1 and z - a > 0.6 * len(passage)


def test_messy(spark):
    rows = {r.doc_id: r for r in substring.dedup_units(messy.docs(spark)).collect()}
    assert sorted(rows) == list(range(1, 10))
    assert rows[2].text == "" and [tuple(x) for x in rows[2].removed] == [(0, 70)] and rows[1].n_removed == 0
    assert rows[3].text == rows[4].text == "" and rows[9].text == "drei" and rows[6].text == messy.LONG
    assert substring.dedup_units(messy.docs(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring.dedup_units(messy.docs(spark), unit="word")


def cut_words(text, removed):
    """(word, whether it is cut) in order."""
    return [(m[0].lower(), any(a <= m.start() and m.end() <= z for a, z in removed)) for m in re.finditer(r"\w+", text)]


def test_passages_without_signs(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [say(n) for n in (44, 51, 60, 200)]
    texts = [say(rng.randrange(40)) + " " + p + " " + say(rng.randrange(40)) for p in passages * 3] + ["", say(5), say(300)]
    d = messy.table(spark, *texts)
    assert all(r.n_removed == 0 for r in substring.dedup_units(d).collect())
    rows = {r.doc_id: r for r in substring.dedup_units(d, window=substring.WINDOW).collect()}
    for i, t in enumerate(texts):
        words = cut_words(t, [tuple(x) for x in rows[i].removed])
        held = " ".join(w for w, gone in words if gone)
        if i < len(passages) or i >= 3 * len(passages):
            assert rows[i].n_removed == 0 and rows[i].text == t
        else:
            p = passages[i % len(passages)]
            assert held in p and len(held.split()) >= len(p.split()) - 2 * substring.WINDOW - 8 and rows[i].n_removed == 1


def test_passages_take_all_that_lines_take_and_repeats_alone(spark):
    held = texts(11)
    d = spark.createDataFrame(list(held.items()), "doc_id long, text string")
    less = {r.doc_id: {k for a, z in r.removed for k in range(a, z)} for r in substring.dedup_units(d).collect()}
    more = {r.doc_id: {k for a, z in r.removed for k in range(a, z)} for r in substring.dedup_units(d, window=substring.WINDOW).collect()}
    assert all(less[i] <= more[i] for i in held) and less != more
    seen = {}
    words = {i: [(m.start(), m[0]) for m in WORD.finditer(t.lower())] for i, t in held.items()}
    for i, w in words.items():
        for k in range(len(w) - 19):
            seen.setdefault(tuple(x for _, x in w[k : k + 20]), []).append((i, k))
    for i, w in words.items():
        fair = {k + j for places in seen.values() if len(places) > 1 for o, k in places if o == i and (o, k) != min(places) for j in range(20)}
        assert all(k in fair for k, (at, _) in enumerate(w) if at in more[i] - less[i])


def test_short_lines_that_repeat(spark, tmp_path):
    held = ["Of edti oner.\nalone here", "one\nOf EDTI oner\n...\ntwo", "And ornd.\n...\nthree", "four\nAnd ornd."]
    messy.table(spark, *held).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.removed) for r in substring.op4_passages(spark, str(tmp_path)).collect()}
    assert got == {0: (held[0], ""), 1: ("one\n...\ntwo", "4-17"), 2: (held[2], ""), 3: ("four\n", "5-14")}


def test_ids_of_any_type(spark):
    line = "one two three four five six seven eight nine"
    d = spark.createDataFrame([("b", f"{line}\nown text"), ("a-c", f"first\n{line}"), (None, line)], "doc_id string, text string")
    assert sorted((r.doc_id, r.text, r.n_removed) for r in substring.dedup_units(d).collect()) == [("a-c", f"first\n{line}", 0), ("b", "own text", 1)]
