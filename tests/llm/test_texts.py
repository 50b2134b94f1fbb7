from __future__ import annotations

import random

import pytest

from skein.llm.leaks import covered, leaks, longest_common, words
from skein.llm.mixing import mix, plan
from skein.llm.places import Places, Trie, map_places
from skein.llm.residue import reasons, residue


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_trie_finds_all_within_the_distance():
    rng = random.Random(3)
    words_ = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(120)]
    trie = Trie([(w, i) for i, w in enumerate(words_)])
    for _ in range(80):
        q = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 8)))
        for most in (0, 1, 2):
            assert trie.near(q, most) == {i: osa(q, w) for i, w in enumerate(words_) if osa(q, w) <= most}


PLACES = [(1, ["ჭანოდური", "Chanoduri", "Granite Bay CHA"]), (2, ["ზემო ლარუავი", "Upper Laruavi"]), (3, ["კვიმაშველი", None]), (4, ["ქვარიუბანი"])]


@pytest.mark.parametrize(
    "text,ref",
    [("ჭანოდური", 1), (" CHANODURI ", 1), ("Чанодури", 1), ("ჭანოდურში", 1), ("ჭანოდურთან ახლოს", 1), ("ქ.ჭანოდური", 1), ("საქართველო, ჭანოდური", 1), ("Chanoduri (centre)", 1), ("City of Chanoduri", 1), ("granite bay cha", 1), ("kvimaSveli", 3), ("Wanoduri", 1), ("Zemo Laruavi", 2), ("ქ. ქვარიუბანი", 4), ("ჭნაოდური", 1), ("Kvimashvli", 3), ("N/A", -1), ("", -1), (None, -1), ("Online", -1), ("x" * 20_000, -1)],
)
def test_find(text, ref):
    assert Places(PLACES).find(text) == ref


def test_map_places(spark):
    ref = spark.createDataFrame([(1, "ჭანოდური", "Chanoduri", ["A Bay"]), (2, None, "Kvimashveli", None), (None, "x", "y", None)], "place_ref int, name_ka string, name_en string, aliases array<string>")
    rows = spark.createDataFrame([(5, ["Chanoduri", None, "abroad", ""]), (6, None), (7, []), (8, ["a bay"]), (8, ["a bay"])], "row_id long, c array<string>")
    got = sorted(map(tuple, map_places(rows, "row_id", "c", ref, "place_ref", ["name_ka", "name_en"], "aliases").collect()))
    assert got == [(5, 0, 1), (5, 1, -1), (5, 2, -1), (5, 3, -1), (8, 0, 1), (8, 0, 1)]
    assert {r["place_ref"] for r in map_places(rows, "row_id", "c", ref.limit(0), "place_ref", ["name_ka", "name_en"], "aliases").collect()} == {-1}
    assert map_places(rows.limit(0), "row_id", "c", ref, "place_ref", ["name_ka", "name_en"], "aliases").count() == 0


REAL = "The accountant will plan monthly reports and, on Fridays, compare price lists with the warehouse. We offer 900 lari and lunch on site."


@pytest.mark.parametrize(
    "text,why",
    [
        ("Location: {{company_name}}", "placeholder"), ("Dear *|FNAME|*, welcome. " + REAL, "placeholder"), (REAL + " Contact: %ORG_NAME%.", "placeholder"), ("ხელფასი: [აქ ჩაწერეთ თანხა] ლარი. " + REAL, "placeholder"), ("{0} is hiring. " + REAL, "placeholder"), ("<%= listing.title %> " + REAL, "placeholder"),
        (REAL + " Lorem ipsum dolor sit amet cursus quis tempor nisi varius.", "filler"), ("asdf asdf qwer " * 8, "filler"), (REAL + " Description coming soon." * 4, "filler"), ("ტესტი " * 15, "filler"),
        ("Menu\nJavaScript is disabled. Turn it on and reload to continue.\n© 2026", "notice"), ("Error 502: something went wrong while loading this listing. Try again later.", "notice"), ("სესიის ვადა ამოიწურა, გაიარეთ ავტორიზაცია თავიდან.\nშესვლა", "notice"), ("Internal Server Error\nat A.show (line 5)\nat B.next", "notice"),
    ],
)
def test_residue(text, why):
    assert why in reasons(text)


@pytest.mark.parametrize(
    "text",
    [None, "", " ", REAL, REAL + " You will reduce 404 errors and rewrite the page not found screen so visitors stay.", REAL + " Our price list covers sets {A, B} and {C}; ask for option [2].", REAL + " Duties [full time] include maintenance until 18:00.", REAL + " The designer replaces every lorem ipsum block with real copy.", REAL + "\n```\n{{ company }}\n```\n" + REAL, REAL + " In a template you write variables such as {{ name }} between braces. " + REAL],
)
def test_content_is_kept(text):
    assert reasons(text) == []


def test_residue_table(spark):
    df = spark.createDataFrame([(1, "Location: {{x}}", "a"), (2, REAL, "a"), (3, None, "a"), (4, REAL * 3_000, "a"), (1, "Location: {{x}}", "a")], "doc_id long, text string, k string")
    assert sorted(r["doc_id"] for r in residue(df, "doc_id", "text").collect()) == [1, 1]
    assert residue(df.limit(0), "doc_id", "text").count() == 0


def test_words():
    assert words("Тhe <b>cаt</b>,­ sat<br/>on&nbsp;it") == words("the CAT sat on it")


def test_longest_common_and_runs():
    a, b = [1, 2, 3, 9, 4], [1, 3, 4, 5]
    where = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << j
    assert longest_common(a, where, len(b)) == 3
    assert covered([7, *range(10), 7], list(range(12)), 8).sum() == 10


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(80))) for i in range(12)]
    docs = []
    for d in range(120):
        body = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        if d % 3 == 0:
            w = items[d % 12][1].split()
            n, a = rng.randrange(8, 80), rng.randrange(0, 20)
            body[len(body) // 2 : len(body) // 2] = w[a : a + n]
        docs.append((d, " ".join(body).upper(), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, items[3][1] + " z " * 20_000, "x"), (903, items[3][1], "x"), (903, items[3][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, w string")
    it = spark.createDataFrame([*items, (99, None), (98, "...")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks(df, "doc_id", "text", it, "item_id", "text").where("run_share >= 0.5").collect())
    want = []
    for d, text, _ in docs:
        for i, t in items:
            share = covered([hash(w) for w in words(text or "")], [hash(w) for w in words(t)], 8).mean()
            want += [(d, i)] if share >= 0.5 else []
    assert got == sorted(want) and len(want) > 10
    assert leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_leaks_finds_items_in_scattered_runs(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(80))) for i in range(8)]
    docs = []
    for d in range(60):
        own, body = items[d % 8][1].split(), []
        for a in range(0, 8 * rng.randrange(4, 9), 8):  # 4 to 8 of 10 runs, each among 60 words of other items
            other = [w for i, t in items if i != d % 8 for w in t.split()]
            body += own[a : a + 8] + rng.sample(other, 60)
        docs.append((d, " ".join(body)))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks(df, "doc_id", "text", it, "item_id", "text").where("run_share >= 0.5").collect())
    want = [(d, i) for d, text in docs for i, t in items if covered(words(text), words(t), 8).mean() >= 0.5]
    assert got == want and len(want) > 30


def test_leaks_finds_an_item_that_a_third_of_the_documents_carry(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(80))) for i in range(8)]
    rare, docs = [w for _, t in items[1:] for w in t.split()], []
    for d in range(300):
        if d % 3 == 0:  # the first half of one item in one piece, off the beginning of passages, among rarer words of the others
            docs.append((d, " ".join(rng.sample(rare, 44) + items[0][1].split()[:40] + rng.sample(rare, 44))))
        else:
            docs.append((d, " ".join(f"x{rng.randrange(500)}" for _ in range(120))))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks(df, "doc_id", "text", it, "item_id", "text").where("run_share >= 0.5").collect())
    assert got == [(d, 0) for d in range(0, 300, 3)]


def test_plan():
    assert plan({"a": (10, 100), "b": (5, 50)}, {"a": (0.5, 2), "b": (0.5, 3), "c": (0.2, 9)}, None) == {"a": 1.5, "b": 3.0}
    assert plan({"a": (10, 100)}, {"a": (1.0, 2)}, 10_000) == {"a": 2.0}
    assert plan({}, {"a": (1.0, 2)}, None) == {}


def test_mix(spark):
    import public_tokenizers as tokenizers

    rng = random.Random(2)
    docs = [(i, "a" if i % 3 else "b", "word " * rng.randrange(1, 60)) for i in range(600)] + [(700, "a", None), (701, "a", ""), (702, "none", "word"), (703, None, "word")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.7, 3), ("gone", 0.5, 2)], "source string, target_share double, max_repeats int")
    mixed, shares = mix(df, "doc_id", "source", "text", targets, "target_share", "max_repeats", tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["a"]["actual_share"] - 0.3) < 0.01 and abs(got["b"]["actual_share"] - 0.7) < 0.01 and got["gone"]["copies"] == 0 and got["none"]["n_documents"] == 1
    rows = mixed.collect()
    assert sum(r["n_tokens"] for r in rows if r["source"] == "b") == got["b"]["tokens"] and max(r["copy_no"] for r in rows) <= 3
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    empty, report = mix(df.limit(0), "doc_id", "source", "text", targets, "target_share", "max_repeats", tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    assert empty.count() == 0 and report.count() == 3
