"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, canon, leaks, mainbody, neardup, pii, repeated, residue, split, survivor

LONG = "word and more, with a sentence. " * 20_000
PAGES = "page_id long, county string, text string, id long, source string, chunk long, grp long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 8, 9) for r in rows], PAGES)


def test_split(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, "a", LONG), (4, "a", "x" * 5000), (4, "a", "x" * 5000), (None, None, "y" * 800), (5, None, "。".join("界" * 50 for _ in range(40)))]
    got = split.split_oversized(pages(spark, rows)).collect()
    by = {r["id"]: r for r in got}
    assert len(got) == len(rows)
    assert by[1]["cut"] is None and by[2]["pieces"] == [] and by[3]["cut"] == "natural" and by[4]["cut"] == "forced" and by[None]["cut"] == "whole" and by[5]["cut"] == "natural"
    for i, _, t in rows:
        p = by[i]["pieces"]
        if t and len(t) > 800:
            assert p[0]["start_pos"] == 1 and p[-1]["end_pos"] == len(t) and all(x["end_pos"] - x["start_pos"] < 800 for x in p)
            assert all(b["start_pos"] == a["end_pos"] - 99 for a, b in zip(p, p[1:]))
    assert split.split_oversized(pages(spark, [])).count() == 0
    pieces = split.piece_texts(pages(spark, rows[2:3])).orderBy("piece_no").collect()
    assert pieces[0]["piece"] + "".join(p["piece"][100:] for p in pieces[1:]) == LONG


@pytest.mark.parametrize("limit, overlap", [(50, 0), (50, 49), (10, 3)])
def test_split_with_other_limits(limit, overlap):
    text = "one two three, four five. six seven\n\neight nine ten eleven-twelve-thirteen-fourteen fifteen " * 5
    p = split.plan_pieces(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text) and all(e - s <= limit for s, e, _ in p) and all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(p, p[1:]))


def test_cuts_prefer_strong_boundaries():
    text = "a b c. " * 62 + "\n\n" + "d e f. " * 50
    assert split.plan_pieces(text, 500, 100)[0][2] == "paragraph"
    with pytest.raises(ValueError):
        split.plan_pieces(text, 100, 100)


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(200))
    edit = base.replace("w100 ", "zzz ")
    rows = [(1, "a", base), (2, None, base), (3, "a", edit), (4, "a", None), (5, "a", ""), (6, "a", "short text"), (7, "a", " ".join(f"v{i}" for i in range(300))), (8, "a", LONG), (8, "a", LONG), (9, "a", LONG.upper()), (None, "a", base)]
    links, members = neardup.near_duplicates(pages(spark, rows).where("page_id is not null"))
    pairs = sorted(map(tuple, neardup.document_pairs(links, members).collect()))
    assert pairs == [(1, 2), (1, 3), (2, 3), (8, 9)]
    groups = {r["id"]: (r["class"], r["near_class"], r["n_links"]) for r in neardup.duplicate_classes(links, members).collect()}
    assert groups == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 1, 1), 7: (7, 7, 0), 8: (8, 8, 0), 9: (8, 8, 0)}
    links, members = neardup.near_duplicates(pages(spark, []))
    assert links.count() == 0 and members.count() == 0


def test_near_duplicates_against_brute_force(spark):
    import random

    r = random.Random(3)
    texts = []
    for _ in range(12):
        t = [f"t{r.randrange(60)}" for _ in range(r.randrange(62, 200))]
        texts.append(t)
        for _ in range(r.randrange(1, 12)):
            u = list(texts[-1]) if r.random() < 0.5 else list(t)
            for _ in range(r.randrange(0, 14)):
                k = r.randrange(len(u))
                u[k : k + r.randrange(0, 2)] = [f"t{r.randrange(60)}"] * r.randrange(0, 3)
            texts.append(u)
    rows = [(i, "a", " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: {tuple(t[k : k + 3]) for k in range(len(t) - 2)} for i, t in enumerate(texts) if len(t) >= 60}
    wanted = sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) - 1e-9)
    got = sorted(map(tuple, neardup.document_pairs(*neardup.near_duplicates(pages(spark, rows))).collect()))
    assert len(wanted) > 30 and got == wanted


def test_hot_group_of_near_copies(spark):
    """More members than a group may have: the group is divided, no link is lost."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, "a", " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate([5] * 50 + [60] * 50)]
    links, members = neardup.near_duplicates(pages(spark, rows))
    assert links.count() == 100 * 99 // 2 and members.count() == 100


def test_repeated_lines(spark):
    rows = [(i, " Kern County " if i % 2 else "kern", f"Share\tthis  PAGE {i}\r\nunique line {'abcdefghij'[i]}\n\n" + ("a very long legal notice that takes more than one chunk of content, " * 5 + str(i))) for i in range(8)]
    rows += [(20, None, "Share this page 1"), (21, "kern", None), (22, "kern", ""), (0, " Kern County ", rows[0][2]), (23, "other", "Share this page 1")]
    lines = repeated.repeated_lines(pages(spark, rows))
    assert sorted(map(tuple, lines.collect())) == sorted((i, n) for i in range(8) for n in (1, 4))
    joined = repeated.repeated_lines(pages(spark, rows), broadcast_chunks=0)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, lines.collect()))
    clean = {r["id"]: r["text"] for r in repeated.remove_lines(pages(spark, rows), lines).collect()}
    assert clean[3] == "unique line d\n" and clean[20] == "Share this page 1" and clean[21] is None and clean[22] == ""
    assert repeated.repeated_lines(pages(spark, [])).count() == 0


def test_chunks_do_not_depend_on_the_place():
    import numpy as np

    line = "Some notice of many words that is repeated under every page of the site, in English and in español."
    a, b = (repeated.chunk_texts([t], np.zeros(1, np.uint64)) for t in (line, "before\n\n" + line + "\nbehind"))
    at = list(b[1]).index(3)
    start = int(b[2][:at].sum())
    assert list(a[3]) == list(b[3][start : start + b[2][at]]) and len(a[3]) > 1


def test_main_body(spark):
    text = "Home\nNews\nForms\nGetting food boxes\nCall 555-555-0100 and ask for a nurse.\n\nWe use cookies to help.\nRead more about x\nHow a nurse can help\nShare this page"
    rows = [(1, "a", text), (1, "a", text), (2, "a", None), (3, "a", " \n "), (4, "a", LONG), (None, "a", "Home")]
    labels = spark.createDataFrame([(1, 4, True), (1, 1, False), (1, None, True), (9, 1, None)], "page_id long, line_no int, is_main boolean")
    for known in (labels, labels.where("false")):
        got = mainbody.line_verdicts(pages(spark, rows), known).where("id = 1 and is_main").select("line_no").distinct().collect()
        assert sorted(r[0] for r in got) == [4, 5]
    bodies = {r["id"]: r["body"] for r in mainbody.main_bodies(pages(spark, rows), labels).collect()}
    assert bodies[2] is None and bodies[3] == "" and bodies[4] == LONG and bodies[1].startswith("Getting")
    assert mainbody.line_verdicts(pages(spark, []), labels).count() == 0


def test_held_out_accuracy_of_main_body(spark, folder):
    both = [mainbody.load_labels(spark.read.parquet(f"{folder}/raw_pages.parquet"), spark.read.parquet(f"{folder}/line_labels.parquet"))][0]
    fit, rest = both[::2], both[1::2]
    w = mainbody.fit(fit)
    pairs = [(dict(mainbody.is_main(mainbody.visible_lines(t), w)).get(n), m) for _, t, ls in rest for n, m in ls.items()]
    assert len(pairs) > 100 and sum(a == b for a, b in pairs) >= 0.98 * len(pairs)


def test_residue(spark):
    body = "How a midwife can help\nPartners are welcome when we discuss warning signs after birth.\nPlease enable JavaScript to use the translation tool."
    rows = [(1, "a", "Home\nNews\nPage not found\nThe address /x/y does not exist on this server."), (2, "a", body), (3, "a", "Dear {{first_name}}, welcome to the class today."), (4, "a", "Lorem ipsum dolor sit amet elit sed do."), (5, "a", None), (6, "a", ""), (7, "a", "The form has a box marked [optional] that you may skip. Save 50 % or 20 % now."), (8, "a", LONG), (1, "a", "Home\nNews\nPage not found\nThe address /x/y does not exist on this server."), (9, "a", "Traceback (most recent call last):\nKeyError: 'x'")]
    got = {r["id"]: r["reason"] for r in residue.residue_pages(pages(spark, rows)).collect()}
    assert got == {1: "message", 3: "residue", 4: "residue", 9: "message"}
    assert residue.residue_pages(pages(spark, [])).count() == 0


@pytest.mark.parametrize("slot", ["{{ name }}", "{hours}", "${county}", "#{x}", "%phone%", "@@name@@", "[[hours]]", "__county__", "<%= x %>", "<insert hours>", "[YOUR NAME]", "[INSERT x HERE]", "[object Object]", "XX/XX/20XX", "undefined undefined"])
def test_slots(slot):
    text = f"We text a reminder {slot} hours before"
    assert residue.has_residue([text], text, text.lower())


@pytest.mark.parametrize("text", ["a box marked [optional]", "[image: county seal]", "Write your due date as MM/DD on the card.", "_" * 300, "a < b and c > d", "100% of 50% off"])
def test_no_slots(text):
    assert not residue.has_residue([text], text, text.lower())


def test_prefix_tree():
    tree = residue.PrefixTree()
    assert tree.add("error <*> on line one")[0] == ["error", "<*>", "on", "line", "one"]
    assert tree.add("error <*> on line two")[0] == ["error", "<*>", "on", "line", "<*>"]
    assert tree.add("page not found")[0] == ["page", "not", "found"]


def test_survivors(spark):
    rows = [
        ("k", 5, 1, "2025-01-01", "a@b.example"), ("k", 4, 5, "2025-01-01", "Not Found "), ("k", 3, 3, "06/17/2025", "c@d.example"), ("k", 2, 3, "June 17, 2025", "e@f.example"), ("k", 9, 3, None, "g@h.example"),
        ("single", 10, 5, "2025-01-01", "x@y.example"), ("single", 10, 5, "2025-01-01", "x@y.example"), (None, 11, 5, None, "n@n.example"), (None, 12, 5, None, "n@n.example"), ("bad", 13, None, "??", "@b.example"), ("bad", 14, None, "", "a@@b.example"), ("t", 15, None, "2025-02-30", "t@t.example"), ("t", 16, None, None, "u@u.example"),
    ]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "county_code string, record_id long, source_trust int, last_updated string, mail string, trust int, value string")
    got = survivor.survivors(df, "county_code", {"mail": survivor.usable_email(F.col("mail"))})
    assert sorted(map(tuple, got.collect())) == [("k", "mail", 2, "e@f.example"), ("t", "mail", 15, "t@t.example")]
    assert survivor.survivors(df.where("false"), "county_code", {"mail": F.col("mail")}).count() == 0


@pytest.mark.parametrize("text, day", [("2025-06-17T22:00:00", "2025-06-17"), (" 2025-03-24 ", "2025-03-24"), ("01/02/2026", "2026-01-02"), ("April 1, 2025", "2025-04-01"), ("Unknown", None), ("", None), ("2025-13-01", None), ("13/13/2025", None)])
def test_days(spark, text, day):
    assert str(spark.range(1).select(survivor.calendar_day(F.lit(text)).alias("d")).first()["d"]) == str(day)


def names(spark):
    return spark.createDataFrame([("E1", "Cradle Bridge Home Visiting Program", False), ("E1", "cradle bridge", False), ("E2", "Food & Nutrition Aid", False), ("E1", "CBHV", True), ("E3", None, False)], "entry_id string, name string, is_acronym boolean")


@pytest.mark.parametrize("value, entry", [("Crade Bridge Home Visiitng Program", "E1"), ("NEW! cradle-bridge", "E1"), ("C.B.H.V.", "E1"), ("Visiting Program, Cradle Bridge Home", "E1"), ("Food_and_Nutr._Aid (2 of 3)", "E2"), ("Fóod & Nutrition Aid - Kern County", "E2"), ("Roads and Paving", "UNMATCHED"), ("x" * 5000, "UNMATCHED"), ("tbd", None), (None, None), ("  ", None)])
def test_canonical(spark, value, entry):
    df = spark.createDataFrame([(1, value, "z"), (1, value, "z")], "record_id long, field string, v0 string")
    got = canon.map_values(df, {"field": names(spark)}).select("entry_id").distinct().collect()
    assert [r[0] for r in got] == ([entry] if entry else [])


def test_canonical_in_shards_and_without_entries(spark):
    df = spark.createDataFrame([(1, "Food and Nutrition Ayd"), (2, "cradle brigde")], "record_id long, field string")
    whole, shards = (sorted(map(tuple, canon.map_values(df, {"field": names(spark)}, shard_names=n).collect())) for n in (100, 1))
    assert whole == shards and [r[2] for r in whole] == ["E2", "E1"]
    assert {r["entry_id"] for r in canon.map_values(df, {"field": names(spark).where("false")}).collect()} == {"UNMATCHED"}
    assert canon.map_values(df.where("false"), {"field": names(spark)}).count() == 0


def test_bk_tree_finds_what_a_scan_finds():
    import random

    r = random.Random(1)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    tree = canon.BKTree()
    for w in words:
        tree.add(w)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *[0] * len(b)] if False else _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return out

    for q in words[:40]:
        assert all(canon.distance(q, w) == plain(q, w) for w in words[:50])
        assert tree.within(q, 2) == sorted((plain(q, w), w) for w in set(words) if plain(q, w) <= 2)


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, ids int, kind string")


def test_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = [None, "", " \n ", "<|endoftext|> x", "Ünïcode ½ 三 é \x1c\x85 ", "it's we'll  a\n\n b", "a" * 20_000, LONG]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(docs(spark, list(enumerate(texts)))).collect()}
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    assert got[0] is None and got[1] == []
    assert all(got[i] == t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts) if x)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_corpus(bpe.encode_corpus(docs(spark, list(enumerate(texts))))).collect()}
    assert back == dict(enumerate(texts))
    assert bpe.encode_corpus(docs(spark, [])).count() == 0


def test_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, "x " + item.upper().replace(" ", ", ") + " y"), (2, "x alpha beta gamma delta epsilon zeta eta theta iota"), (3, "alpha beta gamma WRONG epsilon zeta eta theta iota kappa lambda mu"), (4, None), (5, ""), (6, LONG), (1, "x " + item)]
    items = spark.createDataFrame([(7, item, 0), (7, item, 0), (8, None, 0), (9, "too short", 0)], "item_id long, text string, doc_id int")
    for block in (10**6, 1):
        got = leaks.leaks(docs(spark, rows), items, block_chars=block).select("doc_id", "item_id", "distance").distinct().collect()
        assert sorted(map(tuple, got)) == [(1, 7, 0), (2, 7, 1), (3, 7, 1)]
    assert leaks.leaks(docs(spark, []), items).count() == 0
    assert leaks.leaks(docs(spark, rows), items.where("false")).count() == 0


def test_leaks_against_brute_force():
    import random

    r = random.Random(5)
    item = [f"w{r.randrange(8)}" for _ in range(40)]
    index = leaks.Index([(1, " ".join(item))], 10, 1)
    grams = {tuple(item[k : k + 10]) for k in range(31)}
    for _ in range(60):
        t = [f"w{r.randrange(8)}" for _ in range(30)]
        if r.random() < 0.5:
            k = r.randrange(30)
            t[10:10] = item[k : k + r.randrange(7, 12)]
        exact = any(tuple(t[k : k + 10]) in grams for k in range(len(t) - 9))
        assert exact == any(m[2] == 0 for m in index.matches([" ".join(t)], 1))


def test_myers():
    assert leaks.myers([1, 2, 3], [9, 1, 2, 3, 9]) == 0 and leaks.myers([1, 2, 3], [1, 9, 3]) == 1 and leaks.myers([1, 2], []) == 2 and leaks.myers([], [1]) == 0


KNOWN = [("Tindra", "given"), ("Paloma", "given"), ("Phamlin", "family"), ("Abernoth", "family"), (None, "given")]


def test_personal_information(spark):
    text = "Thanks, Tindra Phamlin, (236) 555-0102. Write to paloma.x [at] mail [dot] example or call 211.\nClient Abernoth, Paloma of 12-B West Oak Lane gave the number 000-37-8605; Lot 21271685 of Oak Lane."
    rows = [(1, text), (2, None), (3, ""), (4, LONG), (5, "T. PHAMLIN and Gostav Phamlin"), (6, "Gostav Abernoth; Gostav Zarix; Tindra Zarix; Paloma Zarix; Gostav Phamlin"), (1, text)]
    known = spark.createDataFrame([(*k, 1) for k in KNOWN], "name_text string, name_kind string, text int")
    for most in (10**6, 0):
        got = {(r["doc_id"], r["kind"], r["found"]) for r in pii.personal_information(docs(spark, rows), known, broadcast_words=most).collect()}
        assert {x[1:] for x in got if x[0] == 1} == {("name", "Tindra Phamlin"), ("phone", "(236) 555-0102"), ("email", "paloma.x [at] mail [dot] example"), ("name", "Abernoth, Paloma"), ("address", "12-B West Oak Lane"), ("id_number", "000-37-8605")}
        assert {x[2] for x in got if x[0] == 5} == {"T. PHAMLIN", "Gostav Phamlin"} and not any(x[0] in (2, 3, 4) for x in got)
        assert "Gostav Zarix" in {x[2] for x in got if x[0] == 6}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, rows), known).collect()}
    assert clean[1].startswith("Thanks, <NAME>, <PHONE>. Write to <EMAIL> or call 211.\nClient <NAME> of <ADDRESS> gave the number <ID_NUMBER>; Lot 21271685")
    assert clean[2] is None and clean[3] == "" and clean[4] == LONG
    assert pii.personal_information(docs(spark, []), known).count() == 0
    assert {r["kind"] for r in pii.personal_information(docs(spark, rows), known.where("false")).collect()} == {"phone", "email", "address", "id_number"}


@pytest.mark.parametrize("text", ["Meet @ Sorrelby Window at 3 p.m.; tag us @Wrenfield.", "Version 2.24.67 replaced 1.47.", "Grant 24-1498-8 covers it.", "Use form MCH 1702-14.", "Resolution 2022-2756 under item 48-27-1855.", "The invoice total was $2637.46.", "In 2019 the Larkmoor team drove 1396 miles beyond Willowend Road.", "Dial 211 or text 5520."])
def test_decoys(text):
    assert pii.find_pii(text, pii.NameModel({})) == []


def test_equal_words_of_a_document_agree():
    """Oak Abernoth alone is no name; where Oak stands as a given name elsewhere, the skip edge tips it."""
    table = {"tindra": (4.0, -6.0), "abernoth": (-6.0, 4.0), "zarix": (-6.0, -1.2)}
    model = pii.NameModel(table)
    assert model.names("Tindra Zarix") == [(0, 12)]
    assert pii.NameModel({}).names("Tindra Zarix") == []
