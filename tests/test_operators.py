"""Small literal cases for rules that SQL cannot state, and brute-force twins of the greedy passes."""

import json
import math
import random
import re
import time
import zlib
from collections import Counter

from pyspark.sql import functions as F

from florilege.functions import amounts, arrow
from florilege.functions import text as X
from florilege.functions import urls as U
from florilege.functions.profile import pick_segment, taste
from florilege.functions.scoring import parse_budget, retry_seconds
from florilege.operators import alike
from florilege.operators import joins as J
from florilege.operators import pages as P
from florilege.operators import quality as Q
from florilege.operators import restructure as K
from florilege.operators import similarity as S
from florilege.operators.aggregates import item_overview
from florilege.operators.models import group_folds, hashed_ngrams, hashed_vectors
from florilege.operators.primitives import running
from florilege.operators.quotes import verbatim_share, word_tokens
from florilege.operators.ranking import expert_override
from florilege.operators.sequences import cap_variants
from florilege.operators.versions import line_changes
from florilege.sources import stores as A
from florilege.streaming.streams import VersionedTable


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_clean_text(spark):
    body = "Contents\nRoots\nLeaves\n\nRoots\nThe root is dug in autumn and dried in the shade.\nLeaves\nRead more about it\n" \
        "The root is dug in autumn and dried in the shade.\n\n\n\nEnd of page"
    cleaned = one(spark, X.clean_text(X.marked_lines(F.lit(body))))
    assert cleaned == "Roots\nThe root is dug in autumn and dried in the shade.\nLeaves\n\nEnd of page"
    assert one(spark, X.clean_text(X.marked_lines(F.lit(cleaned)))) == cleaned


def test_paragraphs(spark):
    body = "a" * 50 + "\n" + "b" * 160 + "\n\n" + "c. " * 700 + "\nend"
    parts = one(spark, X.paragraphs(F.lit(body)))
    assert parts[0] == "a" * 50 + "\n" + "b" * 160
    assert all(len(p) <= 1504 for p in parts) and parts[-1].endswith("\nend")


def test_numbers(spark):
    found = one(spark, amounts.numbers(F.lit("1 1/2 cups, 1.000 g, 2,5 ml, 3½ tsp, 7/0, XIX wiek, 12  3/4")))
    assert found == [0.5, 0.75, 1.0, 1.5, 2.5, 3.0, 3.5, 12.0, 19.0, 1000.0]
    assert one(spark, amounts.numbers(F.lit("no number, i w lesie"))) == []


def test_snap_quote(spark):
    source = "First words. The root of the plant was dug in autumn, says the book. Last words."
    rows = spark.createDataFrame([("root of the plant was dug in autumn", source), ("nothing like that at all here", source)], "q string, s string")
    got = [r["x"] for r in rows.select(arrow.snap_quote(F.col("q"), F.col("s")).alias("x")).collect()]
    assert got == ["The root of the plant was dug in autumn, says the book.", None]


def test_metric_units(spark):
    assert one(spark, amounts.metric_units(F.lit("2 cups water at 350°F"))) == "480 ml (2 cups) water at 175°C (350°F)"
    text = F.lit("1 1/2 cups, 5 lbs flour and ½ oz salt, 2 gallons, 1/8 oz (3 cups)")
    assert one(spark, amounts.metric_units(text)) == "360 ml (1 1/2 cups), 2270 g (5 lbs) flour and 14 g (1/2 oz) salt, 7,6 l (2 gallons), 4 g (1/8 oz) (3 cups)"


def test_lines_in_common(spark):
    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(3)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(1, 14))], [rng.choice("abcd") for _ in range(rng.randint(1, 14))]) for _ in range(40)]
    df = spark.createDataFrame([(i, "\n".join(a), "\n".join(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: (r.added, r.removed) for r in line_changes(df, ["i"], "a", "b").collect()}
    assert got == {i: (len(b) - longest(a, b), len(a) - longest(a, b)) for i, (a, b) in enumerate(pairs)}


def test_variants_of_one_address(spark):
    rows = [(i, f"https://x.example/{i % 2}?p={i}") for i in range(10)] + [(20 + i, "https://x.example/plain") for i in range(5)]
    got = cap_variants(spark.createDataFrame(rows, "id int, url string"), "url", "id", 2)
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 20, 21, 22, 23, 24]


def test_expert_changes_only_reviewed_rows(spark):
    recs = spark.createDataFrame([(1, 7), (2, 9)], "number long, priority long")
    over = spark.createDataFrame([(2, 11), (5, 1)], "number long, priority long")
    new = spark.createDataFrame([(i, 3) for i in range(7)], "position long, priority long")
    got = sorted((r.number, r.priority, r.outcome) for r in expert_override(recs, over, "number", new).collect())
    assert got == [(1, 7, "kept"), (2, 5, "changed"), (3, 3, "added"), (4, 3, "added"), (5, 1, "rejected"), (5, 3, "added"), (6, 3, "added"), (7, 3, "added")]


def test_folds_are_even_for_any_number_of_groups(spark):
    rng = random.Random(5)
    rows = [(f"g{g}", "ab"[g % 7 == 0]) for g in range(3000) for _ in range(rng.choice((1, 1, 2, 5)))]
    df = spark.createDataFrame(rows, "grp string, label string")
    folds = group_folds(df, "grp", "label", 5)
    assert folds.count() == 3000
    sizes = [r["count"] for r in df.join(folds, "grp").groupBy("fold", "label").count().filter("label = 'a'").collect()]
    assert len(sizes) == 5 and max(sizes) <= 1.05 * min(sizes)
    assert sorted(r.fold for r in group_folds(df.filter("grp IN ('g1', 'g2')"), "grp", "label", 5).select("fold").collect()) == [0, 1]


def test_inserts_equal_the_sequential_walk(spark):
    rng = random.Random(9)
    words = "root leaf dried autumn shade water boiled flower spring honey bark cut tea sweet bitter".split()
    rows = [(e, "p", i, " ".join(rng.sample(words, rng.randint(3, 8)) if rng.random() < 0.5 else rng.sample(words[:6], 5))) for i, e in enumerate("xy" * 200)]
    df = spark.createDataFrame(rows, "e string, p string, n long, t string").withColumn("f", F.col("n") % 50).withColumn("u", F.col("n") % 3)
    stems = {r.n: set(r.s) for r in df.select("n", X.stems(F.col("t")).alias("s")).collect()}
    want = []
    for entity in "xy":
        kept = []
        for e, _, n, t in rows:
            if e == entity:
                k = next((k for k in kept if stems[n] and len(stems[n] & stems[k["shown"]]) >= 0.5 * len(stems[n] | stems[k["shown"]])), None)
                if k is None:
                    kept.append({"n": n, "shown": n, "all": [n], "t": t})
                else:
                    k["all"].append(n)
                    if len(t) > len(k["t"]):
                        k["t"], k["shown"] = t, n
        want += [(k["n"], k["t"], sorted({n % 50 for n in k["all"]}), sorted({n % 3 for n in k["all"]})) for k in kept]
    got = K.place_inserts(df, "e", "p", "n", "t", "f", "u").collect()
    assert sorted((r.n, r.t, sorted(r.f), r.u) for r in got) == sorted(want)


def test_inserts_of_one_group_of_a_third_of_the_rows(spark):
    """Template texts that are all alike, their lengths in any order, beside texts that share their words in part."""
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("leaf", "root", "bark") for b in "xyz" for c in "klmnop"]
    rows = [("x", "p", i, ("gather dried flowers in early autumn shade " + "and wait " * rng.randint(0, 30)) if i % 3 == 0 else " ".join(rng.sample(words, 6))) for i in range(900)]
    df = spark.createDataFrame(rows, "e string, p string, n long, t string").withColumn("f", F.col("n")).withColumn("u", F.lit(1))
    stems = {r.n: set(r.s) for r in df.select("n", X.stems(F.col("t")).alias("s")).collect()}
    kept = []
    for _, _, n, t in rows:
        k = next((k for k in kept if len(stems[n] & stems[k["shown"]]) >= 0.5 * len(stems[n] | stems[k["shown"]])), None)
        if k is None:
            kept.append({"n": n, "shown": n, "all": [n], "t": t})
        else:
            k["all"].append(n)
            if len(t) > len(k["t"]):
                k["t"], k["shown"] = t, n
    got = K.place_inserts(df, "e", "p", "n", "t", "f", "u").collect()
    assert sorted((r.n, r.t, r.f, r.merged) for r in got) == sorted((k["n"], k["t"], k["all"], len(k["all"])) for k in kept)
    assert max(r.merged for r in got) >= 300


ORIGINAL = ["Leczenie łagodnych stanów depresyjnych i lękowych.", "Działa żółciopędnie i rozkurczowo."]
POINTS = ["Napar z ziela działa żółciopędnie.", "Stosowany na oparzenia skóry."]


def merged(spark, answers, originals=ORIGINAL, points=POINTS):
    """Slots named by the answers; rows as (kind, text, cited) by slot, and the slot's own row."""
    a = spark.createDataFrame(list(answers.items()), "slot string, answer string")
    o = spark.createDataFrame([(s, i, t) for s in answers for i, t in enumerate(originals)], "slot string, unit int, text string")
    p = spark.createDataFrame([(s, i, t) for s in answers for i, t in enumerate(points, 1)], "slot string, point int, text string")
    rows, slots = K.apply_merge_answers(a, o, p, "slot")
    told = {s: [] for s in answers}
    for r in sorted(rows.collect(), key=lambda r: (["sentence", "original", "point"].index(r.kind), r.place)):
        told[r.slot].append((r.kind, r.text, r.cited))
    return told, {r.slot: r for r in slots.collect()}


def test_answers_are_repaired(spark):
    whole = " ".join(ORIGINAL)
    said = lambda *rows, aside=(): json.dumps({"zdania": [{"tekst": t, "z": z} for t, z in rows], "nie_pasuje": list(aside)})
    answers = {
        "fine": said((ORIGINAL[0], []), ("Działa żółciopędnie (także napar z ziela) i rozkurczowo.", ["P1"]), aside=[2]),
        "wrong number": "```json\n" + said((whole, []), (POINTS[0], 2), aside=["2"]) + "\n```",
        "lost": said((POINTS[0], [1])),
        "invented": said((whole, []), (POINTS[0], [1]), ("Leczy też cukrzycę i nowotwory trzustki u dzieci.", [2]), ("Na oparzenia skóry<script>.", [2])),
        "number": said((whole, []), (POINTS[0], [1]), ("Napar z ziela działa żółciopędnie od 1990 roku.", [1])),
        "junk": said(("Roślina rośnie na Marsie od 1990 roku.", [1]), ("Leczy wszystkie choroby świata natychmiast.", [2])),
        "no json": "to nie jest JSON",
        "empty": "{}",
        "null": None,
    }
    told, slots = merged(spark, answers)
    assert told["fine"] == [("sentence", ORIGINAL[0], []), ("sentence", "Działa żółciopędnie (także napar z ziela) i rozkurczowo.", [1])]
    assert (slots["fine"].dropped, slots["fine"].lost, slots["fine"].missing, slots["fine"].aside) == (0, 0, 0, [2])
    assert told["wrong number"][-1] == ("sentence", POINTS[0], [1]) and slots["wrong number"].aside == [2]
    assert ("original", ORIGINAL[0], []) in told["lost"] and ("point", POINTS[1], [2]) in told["lost"] and slots["lost"].lost >= 1
    texts = " ".join(t for _, t, _ in told["invented"])
    assert "cukrzyc" not in texts and "<script" not in texts and POINTS[1] in texts and slots["invented"].dropped == 2
    assert [t for k, t, _ in told["number"] if k == "sentence"] == [whole, POINTS[0]]
    for s in ("junk", "no json", "empty", "null"):
        assert slots[s].state == "refused" and told[s] == [], s


def test_paraphrase_is_faithful_to_several_sources(spark):
    told, slots = merged(spark, {"s": json.dumps({"zdania": [{"tekst": "Garbniki występują w stężeniu ok. 6% w liściach.", "z": [1]}]})}, [], ["Garbniki (ok. 6%)", "Liście zawierają około 6,5% garbników."])
    assert slots["s"].state == "merged" and told["s"][0][0] == "sentence"


def test_points_join_the_originals(spark):
    originals = ["Ziele zbierano w noc świętojańską i wieszano w oknach.", "Ziele zbierano w noc świętojańską i wieszano w oknach domu."]
    points = ["Ziele zbierano w noc świętojańską i wieszano w oknach domów.", "Nazwa pochodzi od kropek widocznych na liściach pod światło.", "Nazwa pochodzi od kropek na liściach, widocznych pod światło."]
    o = spark.createDataFrame([("x", i, t) for i, t in enumerate(originals)], "slot string, nr long, text string")
    p = spark.createDataFrame([("x", 10 + i, t) for i, t in enumerate(points)] + [("y", 20, points[0])], "slot string, nr long, text string")
    got = {r.nr: (r.sentence, r.merged) for r in K.merge_points(p, ["slot"], "nr", "text", originals=o).collect()}
    assert got == {10: (got[10][0], True), 11: (11, False), 12: (11, True), 20: (20, False)} and got[10][0] in (0, 1)


def test_versions_outlive_a_restart(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n long")
    first = VersionedTable(spark, str(tmp_path / "t"), "k string, n long", ["k"], parts=4)
    first.write(rows(*[(f"k{i}", i) for i in range(20)]), 0)
    again = VersionedTable(spark, str(tmp_path / "t"), "k string, n long", ["k"], parts=4)
    for _ in range(2):  # a replayed batch starts from the same state
        new = rows(("k3", 100), ("z", 1))
        merged = again.touched(new, 1).unionByName(new).groupBy("k").agg(F.max("n").alias("n"))
        again.write(merged, 1)
    got = {r.k: r.n for r in VersionedTable(spark, str(tmp_path / "t"), "k string, n long", ["k"], parts=4).read().collect()}
    assert got == {f"k{i}": i for i in range(20)} | {"k3": 100, "z": 1}


def test_verbatim_share(spark):
    share = verbatim_share(word_tokens(F.lit("dig the root now please")), word_tokens(F.lit("you dig the root now in spring")))
    assert one(spark, share) == 0.8


def test_url_rules(spark):
    assert one(spark, U.normalize_url(F.lit("HTTPS://WWW.Example.org/a?utm_source=x&b=1#top"))) == "https://www.example.org/a?b=1"
    assert one(spark, U.registrable_domain(F.lit("https://blog.herbs.co.uk/x"))) == "herbs.co.uk"
    assert one(spark, U.url_pattern(F.lit("https://x.org/recipes/12/green-tea-salve"))) == "/recipes/{n}/{slug}"
    assert one(spark, U.absolute(F.lit("b.html"), F.lit("https://x.org/a/c.html"))) == "https://x.org/a/b.html"


def test_limits(spark):
    assert one(spark, retry_seconds(F.lit("Please try again in 1m23.5s."))) == 83.5
    assert one(spark, parse_budget(F.lit("a=1_000, b=x,c=5"))) == {"a": 1000, "c": 5}


def test_running_matches_a_plain_window(spark):
    rows = [(random.Random(i).choice("ab"), i, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = running(df, ["k"], [F.asc("i")], F.floor(F.col("i") / 16), {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
    want, state = {}, {}
    for k, i, v in rows:
        s, m = state.get(k, (0, 0))
        state[k] = want[i] = (s + v, max(m, v))
    assert {r["i"]: (r["s"], r["m"]) for r in got.collect()} == want


def _copies(n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(5)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            t, c = rng.choice(rows)[1:]
            t, c = set(t), set(c)
            for s in (t, c):
                if s and rng.random() < 0.6:
                    s.discard(rng.choice(sorted(s)))
                    s.add(rng.choice(words))
        else:
            t = set(rng.sample(words, rng.randint(0, 3)))
            c = set(rng.sample(words, rng.randint(0, 8)))
        rows.append((i, sorted(t), sorted(c)))
    return rows


def _sequential(rows):
    def jac(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0

    kept, out = [], {}
    for i, t, c in rows:
        best = None
        for j, t2, c2 in kept:
            a, b = jac(t, t2), jac(c, c2)
            same = ((a >= 0.5 and b >= 0.5) or (b >= 0.9 and a >= 0.34)) if c and c2 else (a >= 0.8 and len(t) >= 2)
            if same and (best is None or a + b > best[0]):
                best = (a + b, j)
        if best is None:
            kept.append((i, t, c))
        out[i] = best[1] if best else None
    return out


def test_near_duplicates_equal_the_sequential_pass(spark):
    for seed, hot in ((3, 1000), (4, 3), (5, 10)):
        rows = _copies(seed=seed)
        df = spark.createDataFrame(rows, "id long, t array<string>, i array<string>")
        got = {r["id"]: r["duplicate_of"] for r in S.near_duplicates(df, "id", hot=hot).collect()}
        assert got == _sequential(rows)


def test_dedup_texts_equals_the_sequential_pass(spark):
    rng = random.Random(5)
    words = [f"stem{chr(97 + i)}" for i in range(20)]
    rows = [(i, "ab"[i % 2], " ".join(rng.sample(words, 4))) for i in range(60)]
    known = [("a", " ".join(words[:4]))]
    df = spark.createDataFrame(rows, "nr long, owner string, text string")
    got = {r["nr"] for r in K.dedup_texts(df, ["owner"], "nr", "text", 0.55, known=spark.createDataFrame(known, "owner string, text string")).collect()}
    kept = {"a": [set(w[:6] for w in known[0][1].split())], "b": []}
    want = set()
    for nr, owner, text in rows:
        s = set(w[:6] for w in text.split())
        if all(len(s & k) / len(s | k) < 0.55 for k in kept[owner]):
            kept[owner].append(s)
            want.add(nr)
    assert got == want


def test_new_paragraphs_waits_for_enough(spark):
    pages = spark.createDataFrame([("u", "x" * 250 + "\n\n" + "short")], "url string, text string")
    seen = spark.createDataFrame([], "url string, seen array<string>")
    first = P.new_paragraphs(pages, ["url"], "text", seen).first()
    assert first["skip"] is None and first["new_text"]
    again = P.new_paragraphs(pages, ["url"], "text", spark.createDataFrame([("u", first["remember"])], "url string, seen array<string>")).first()
    assert again["skip"] == "unchanged"


def test_counter_upsert_is_idempotent(spark):
    current = spark.createDataFrame([("2024-01-01", "view", "a", 5)], "day string, kind string, key string, n long")
    feed = spark.createDataFrame([("2024-01-01", "view", "a", "7", 1), ("2024-01-01", "view", "a", "9", 2), ("2024-01-02", "view", None, "x", 3)], "day string, kind string, key string, n string, seq int")
    once = A.upsert_counters(current, feed, "seq")
    assert [tuple(r) for r in once.collect()] == [("2024-01-01", "view", "a", 9)]
    assert A.upsert_counters(once, feed, "seq").collect() == once.collect()


def test_a_very_long_word_is_cut_to_the_lengths_of_the_pieces_only(spark):
    texts = spark.createDataFrame([(1, "x" * 20_000 + "needle" + "y" * 20_000), (2, "short words")], "id long, t string")
    pieces = spark.createDataFrame([("needle",), ("wor",), ("none",)], "piece string")
    assert sorted(map(tuple, J.word_substrings(texts, "id", F.col("t"), pieces).collect())) == [(1, "needle"), (2, "wor")]
    assert sorted(map(tuple, J.word_prefixes(texts, "id", F.col("t"), pieces).collect())) == [(2, "wor")]


def test_few_pieces_are_searched_as_many_are_joined(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Ab cde, abcdefgh_x ż łan Łąka"), (1, "Ab cde"), (2, "xab cd\u00e9 12345678 de"), (3, ""), (4, None), (5, "ab\ncde a b  abcdefzz")], "id int, t string")
    pieces = spark.createDataFrame([(p,) for p in ("a", "ab", "ab cde", "b c", "cde", "abcdef", "abcdefgh", "bcdefg", "1234567", "lak", "an", "_", "-", "", None, "ab")], "piece string")
    catalogue = spark.createDataFrame([(1, "ab cde", "abcdefgh x"), (2, "abcdefgh", "xab cde"), (3, "łąka", "a b"), (4, "xab", None), (5, "łąka", "q r")], "entity int, name string, latin string")
    keys = spark.createDataFrame([(1, "ab cde"), (1, "ab"), (1, "ab"), (2, "de"), (3, "-x"), (4, "łan ł")], "entity int, key string")
    used = spark.createDataFrame([(1, 2)], "entity int, id int")
    low = F.lower("t")

    def found():
        n = J.norm_text(F.col("t"))
        tables = (
            J.word_substrings(texts, "id", low, pieces), J.word_prefixes(texts, "id", F.col("t"), pieces), J.word_prefixes(texts.select("id", n.alias("n")), "id", F.col("n"), pieces, normal=True),
            J.whole_phrases(texts, "id", n, pieces.filter("piece IN ('ab', 'cde', 'a')"), 1).distinct(), J.whole_phrases(texts, "id", n, pieces.filter("piece = 'ab cde'"), 2).distinct(),
            J.dict_match_best(texts, "id", F.col("t"), catalogue, "entity", F.col("name"), F.col("latin")), J.link_longest(texts, "id", F.col("t"), catalogue, "entity", F.col("name")),
            J.pages_for_entity(texts, "id", "t", keys, "entity", used, 3),
        )
        return [sorted(map(tuple, t.collect())) for t in tables]

    few = found()
    monkeypatch.setattr(J, "FEW", 0)
    assert found() == few
    substrings, prefixes, again, words, pairs = few[:5]
    assert prefixes == again
    assert (1, "bcdefg") in substrings and (5, "b c") not in substrings and (2, "1234567") in substrings
    assert (1, "lak") in prefixes and (2, "ab") not in prefixes and (5, "abcdef") in prefixes
    assert words == [(1, "ab"), (1, "cde"), (2, "cde"), (5, "a"), (5, "ab"), (5, "cde")]
    assert pairs == [(1, "ab cde"), (5, "ab cde")]
    assert few[7] == [(1, 1, 5, 1), (1, 5, 2, 2), (2, 1, 3, 1), (2, 2, 1, 3), (2, 5, 2, 2), (4, 1, 1, 1)]


def test_questions_and_names_that_repeat_do_not_multiply(spark):
    names = spark.range(40_000).select(F.lit("long yellow root").alias("key"), (F.col("id") + 7).alias("entity"), F.col("id").alias("ord"))
    names = names.unionByName(spark.createDataFrame([("long yellow roost", 3, 99_999), ("other", 4, -1)], "key string, entity long, ord long"))
    rows = spark.range(40_000).select("id", F.lit("long yellow roow").alias("q"), F.lit(None).cast("string").alias("latin"))
    rows = rows.unionByName(spark.createDataFrame([(50_000, "other", None), (50_001, "nothing alike", None), (50_002, "long yellow roow", "x y")], "id long, q string, latin string"))
    start = time.time()
    out = J.lookup_with_inflection(rows, "id", "q", "latin", names, names.limit(0), "entity", "ord")
    assert sorted(map(tuple, out.groupBy("entity").count().na.fill(-1).collect())) == [(-1, 2), (4, 1), (7, 40_000)]
    assert time.time() - start < 30


def _features(texts, size):
    """Sparse vector of the texts of one id, as the operator describes it."""
    counts = Counter()
    for text in texts:
        words = re.findall(r"\w+", text.lower())
        for w in words:
            asian = re.search("[\u3040-\u9fff]", w)
            tagged, tag, sizes = (w, "c", (1, 2, 3)) if asian else (f"<{w}>", "g", (3, 4, 5))
            counts.update(tag + tagged[i : i + k] for k in sizes for i in range(len(tagged) - k + 1) if asian or len(w) <= 30)
            counts.update([] if asian else ["w" + w])
        counts.update(f"b{a} {b}" for a, b in zip(words, words[1:]) if not re.search("[\u3040-\u9fff]", a + b))
    cells = Counter()
    for g, n in counts.items():
        cells[zlib.crc32(g.encode()) % (size - 1) + 1] += n
    values = [(0, 1.0)] * len(texts) + [(i, 1 + math.log(n)) for i, n in cells.items()]
    length = math.sqrt(sum(v * v for _, v in values))
    return sorted((i, round(v / length, 9)) for i, v in values)


def test_features_are_counted_where_the_text_lies(spark):
    texts = [(1, "Ala ma kota, ala MA psa aaaa"), (2, ""), (3, "漢字 kanji かな abc漢 漢"), (4, "w" * 40 + " x 😀x a1_b"), (5, "two rows"), (5, "of two rows"), (None, "no id")]
    df = spark.createDataFrame(texts, "id long, text string")
    for size in (16, 65536):
        got = {r["id"]: sorted((i, round(v, 9)) for i, v in zip(r["idx"], r["value"])) for r in hashed_vectors(df, "id", F.col("text"), size).collect()}
        assert got == {k: _features([t for i, t in texts if i == k], size) for k in range(1, 6)}
        assert hashed_ngrams(df, "id", F.col("text"), size).count() == sum(map(len, got.values()))
    # the cells of a text were dealt by row and place, all of them, before
    plan = hashed_ngrams(df, "id", F.col("text"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"hashpartitioning\(id#\d+L?, (?:w|g)#", plan)


def test_pairs_of_a_mapping_are_not_dealt_by_entity(spark):
    items = spark.range(40).withColumnRenamed("id", "item")
    mapping = items.filter("item < 30").crossJoin(spark.range(20).withColumnRenamed("id", "entity"))
    facts = spark.range(100).select((F.col("id") % 25).alias("entity"), (F.col("id") % 2 == 0).alias("on_topic"), F.when(F.col("id") < 50, "new").otherwise("applied").alias("status"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = item_overview(items, mapping, facts, "item", "entity")
        assert "hashpartitioning(entity" not in out._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in out.collect()} == {(i, 80, 40, 40) if i < 30 else (i, 0, 0, 0) for i in range(40)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_long_words_have_their_character_runs_too(spark):
    long = "donaudampfschifffahrtsgesellschaftskapitän"
    df = spark.createDataFrame([(1, f"der {long}")], "id long, text string")
    words = ["der", long]
    grams = {f"g{w[i : i + k]}" for w in (f"<{x}>" for x in words) for k in (3, 4, 5) for i in range(len(w) - k + 1)}
    want = {0} | {zlib.crc32(g.encode()) % 65535 + 1 for g in grams | {f"w{w}" for w in words} | {f"bder {long}"}}
    assert {r.idx for r in hashed_ngrams(df, "id", F.col("text"), longest=None).collect()} == want


def test_alike_sets_are_found_in_blocks_and_few_others_are_read(spark, monkeypatch):
    """Texts of one vocabulary, of very different lengths and of owners of any size: nearly all share a rare word."""
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("leaf", "root", "bark", "seed") for b in "uvwxyz" for c in "klmnop"]
    rows = []
    for i in range(500):
        base = rows[rng.randrange(i)][2].split() if i % 4 == 3 else rng.sample(words, rng.choice((1, 2, 5, 9, 30, 60)))
        kept = [w for w in base if rng.random() < 0.9] or base
        rows.append((rng.choice("aaaaab"), i, " ".join([*kept, *rng.sample(words, rng.randint(0, 1))]), rng.choice(("", "", "", f"quote {i % 90}"))))
    df = spark.createDataFrame(rows, "owner string, id long, t string, q string")
    stems = {i: set(t.split()) for _, i, t, _ in rows}
    like = lambda a, b, least: len(stems[a] & stems[b]) >= least * len(stems[a] | stems[b])

    def walk(least, quotes):
        kept = []
        for o, i, _, q in rows:
            if not any(p == o and (like(i, k, least) or quotes and q and q == r) for p, k, r in kept):
                kept.append((o, i, q))
        return [i for _, i, _ in kept]

    read, plain = [], alike.scored_pairs
    monkeypatch.setattr(alike, "scored_pairs", lambda u, pairs: (read.append(pairs.count()), plain(u, pairs))[1])
    assert len(stems) == 500 and all(len(w) == 6 for w in words)
    for least, few in ((0.55, (4096, 131_072)), (0.6, (25, 25))):
        monkeypatch.setattr(alike, "BLOCKS", few)
        assert sorted(r.id for r in K.dedup_texts(df, ["owner"], "id", "t", least).collect()) == walk(least, False)
    assert sum(read) < 4000  # of 90,000 pairs of the large owner
    monkeypatch.setattr(alike, "BLOCKS", (25, 25))
    units = [len(walk(0.6, True)), K.dedup_texts(df, ["owner"], "id", "t", 0.6, quote="q").count()]
    assert abs(units[0] - units[1]) <= len(rows) - df.select("owner", "t").distinct().count()


def test_sketches_rule_out_pairs_but_no_alike_one(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    left = [(i, rng.sample(words, rng.randint(0, 8)), rng.sample(words, rng.choice((0, 5, 40, 150)))) for i in range(40)]
    right = [(i, [*t[: len(t) - i % 3], *rng.sample(words, i % 2)], [*c[: len(c) - i % 4], "only"]) for i, t, c in left]
    right = [(i, list(dict.fromkeys(t)), list(dict.fromkeys(c))) for i, t, c in right]
    got = {r["id"]: (r["match"], r["verdict"]) for r in S.cross_match(*(spark.createDataFrame(x, "id long, t array<string>, i array<string>") for x in (left, right)), "id").collect()}

    def alike(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0

    want = {}
    for i, t, c in left:
        for j, t2, c2 in right:
            x, y = alike(t2, t), alike(c2, c)
            verdict = "same" if (x >= 0.5 and y >= 0.5) or (y >= 0.8 and x >= 0.3) else "maybe" if (x >= 0.3 and y >= 0.25) or x >= 0.6 or y >= 0.6 else "no"
            if verdict != "no" and (i not in want or x + y > want[i][0]):
                want[i] = (x + y, (j, verdict))
    assert got == {i: v for i, (_, v) in want.items()}
    # a rare word in common, and nothing else
    far = spark.createDataFrame([(k, ["rare", *(f"{k}-{i}" for i in range(99))]) for k in (1, 2)], "id long, w array<string>")
    rows = far.select("id", F.transform("w", lambda w: F.xxhash64(w)).alias("w"))
    key = F.array(F.struct(F.lit("rare").alias("key"), F.lit(0).alias("pos"), F.lit(100).alias("n"), F.lit(0.3).alias("c"), F.lit(0).alias("m")))
    keyed = rows.select("id", key.alias("keys"), F.array(S.sketch("w", 0.3)).alias("sketches"))
    assert S.met(S.keyed(keyed, "id", "keys", "a"), S.keyed(keyed, "id", "keys", "b"), "id", ordered=True).count() == 0
    assert S.met(S.keyed(keyed.drop("sketches"), "id", "keys", "a"), S.keyed(keyed.drop("sketches"), "id", "keys", "b"), "id", ordered=True).count() == 1


def test_notes_are_normalised_once(spark):
    """A note's words are bound once: the accent rule stands once for the note and once for its parts."""
    assert str(taste(pick_segment(F.col("note"), F.lit("sok")))).count("translate(") == 2
    rows = spark.createDataFrame([("gorzki (kora), słodki (sok)",), ("lekko słodki, ostry",), ("lekko słodki (sok)",), ("nijaki (sok)",), ("",), (None,)], "note string")
    got = [r[0] for r in rows.select(taste(pick_segment(F.col("note"), F.lit("sok")))).collect()]
    assert got == ["słodki", "ostry", "słodki", None, None, None]


def test_running_scans_small_keys_whole(spark, capsys, monkeypatch):
    """Keys of few rows take one shuffle; busy keys beside them, null ones too, are cut up with the same values."""
    rows = [(k, i, float(i * 7 % 11)) for k, n in ((1, 3), (2, 40), (None, 25), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    values = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v"))}
    for inclusive in (True, False):
        found = running(df, ["k"], [F.asc("i")], F.floor(F.col("i") / 4), values, inclusive)
        found.explain()
        assert capsys.readouterr().out.count("Exchange") == 1
        few = sorted(map(tuple, found.collect()), key=str)
        monkeypatch.setattr("florilege.operators.primitives.BUSY", 10)
        mixed = sorted(map(tuple, running(df, ["k"], [F.asc("i")], F.floor(F.col("i") / 4), values, inclusive).collect()), key=str)
        monkeypatch.undo()
        want = []
        for k, i, v in rows:
            before = [x for a, b, x in rows if a == k and (b < i or (inclusive and b == i))]
            want.append((k, i, v, len(before), sum(before), max(before, default=None)))
        assert few == mixed == sorted(want, key=str)


def test_binomial_or_genus_has_no_distinct_over_its_pairs(spark, capsys):
    """Every pair once, also for entities that stand twice, with two names, and cards that are pairs already."""
    items = spark.createDataFrame([("a", "Rosa canina", 1), ("a", "Rosa spp.", 2), ("b", "Rosa canina", 5), ("b", "Salix alba", 9), (None, "Rosa spp.", 3), ("c", None, 4)], "item string, note string, card int")
    names = [(1, "Rosa canina"), (1, "Rosa canina"), (2, "Rosa rugosa"), (3, "Salix alba"), (3, "Rosa rugosa"), (4, None), (5, "Salix alba"), (5, "Salix alba"), (None, "Rosa canina")]
    found = J.binomial_or_genus(items, "item", F.col("note"), "card", spark.createDataFrame(names, "entity int, latin string"), "entity", F.col("latin"))
    got = sorted(map(tuple, found.collect()), key=str)
    want = {("a", e) for e in (1, 2, 3, None)} | {(None, e) for e in (1, 2, 3, None)} | {("b", e) for e in (1, 3, 5, None)} | {("c", 4)}
    assert got == sorted(want, key=str)
    found.explain()
    assert not capsys.readouterr().out.split("Physical Plan ==")[1].strip().split("\n")[1].strip(" +-").startswith("HashAggregate")


def test_new_paragraphs_hash_each_paragraph_once(spark):
    long = "The nettle grows by the water and is picked in spring before it flowers. " * 4
    rows = [(1, f"{long}\n\n{'草' * 70}\n\n{'草' * 60}\n\nshort\n\n{long.upper()}"), (2, None), (3, "a\nb\n" + "山 " * 80)]
    pages = spark.createDataFrame(rows, "id int, text string")
    seen = spark.createDataFrame([(1, [])], "id int, seen array<string>")
    found = P.new_paragraphs(pages, ["id"], "text", seen, F.array(F.lit("nettle")))
    got = {r["id"]: r for r in found.collect()}
    assert [got[i]["total"] for i in (1, 2, 3)] == [4, 0, 1] and got[1]["off_topic"] == 1 and got[1]["skip"] is None
    # a paragraph was hashed three times and its script looked at twice at every line before
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha1(") == 1
    cut = pages.select(X.paragraphs(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert cut.count("regexp_count(") == 1


def test_layout_checks_deal_rows_before_they_count(spark):
    facts = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 3), (None, 4), ("c", None)], "e string, fact int")
    text = "a statement of fitting length"
    points = [("a", 1, "x", text, 1), ("a", 1, "x", text, 2), ("b", 9, "odd", text, None), (None, 4, "x", "short", 1), ("c", None, "x", text, 1)]
    sources = spark.createDataFrame([("a", 1), ("a", 1), ("c", 1), (None, 1)], "e string, nr int")
    found = Q.layout_checks(facts, spark.createDataFrame(points, "e string, fact int, section string, text string, source int"), sources, "e", ["x"])
    want = {
        ("a", "fact_twice", 1), ("a", "fact_left_out", 2), ("a", "unknown_source", 1), ("a", "source_number_twice", 1), ("b", "section", 1), ("b", "unknown_source", 1),
        ("b", "unknown_fact", 1), ("b", "fact_left_out", 1), (None, "length", 1), (None, "unknown_source", 1), (None, "unknown_fact", 1), (None, "fact_left_out", 1),
        ("c", "unknown_fact", 1), ("c", "fact_left_out", 1),
    }
    assert {tuple(r) for r in found.collect()} == want
    answers = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 2, None), ("b", 7, False), (None, 4, True)], "e string, fact int, ok boolean")
    judged = Q.layout_answer_checks(facts, answers, "e", "fact", F.col("ok"))
    assert {tuple(r) for r in judged.collect()} == {("a", 0, 2, 0, 2, False), ("b", 1, 0, 1, 1, False), (None, 1, 0, 1, 0, False), ("c", 1, 0, 0, 0, False)}
    # every file counted its own rows by key before, all of them in one table of one task
    for df in (found, judged):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan and "Join" not in plan
