"""Address washing: parts read off an alignment, and candidates from the stored index, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.operators import addresses, matching, search_index, spelling, washing

BLANK = "., "


def plain_edits(a, b, insert=1, update=2, delete=1):
    """(raw place or None, candidate place or None) in order, from a full table and one way back."""
    low_a, low_b = a.lower(), b.lower()
    t = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i in range(len(b) + 1):
        for j in range(len(a) + 1):
            choices = [0] if i == j == 0 else []
            if j:
                choices.append(t[i][j - 1] + insert)
            if i:
                choices.append(t[i - 1][j] + delete)
            if i and j:
                choices.append(t[i - 1][j - 1] + (0 if low_b[i - 1] == low_a[j - 1] else update))
            t[i][j] = min(choices)
    out, i, j = [], len(b), len(a)
    while i or j:
        if j and t[i][j] == t[i][j - 1] + insert:
            j -= 1
            out.append((j, None))
        elif i and t[i][j] == t[i - 1][j] + delete:
            i -= 1
            out.append((None, i))
        else:
            i, j = i - 1, j - 1
            out.append((j, i))
    return out[::-1]


def plain_parts(raw, fields, strict):
    """Walks the edits one by one; fields are the candidate's (name, value) in order, strict says which must end at white space."""
    raw = raw.strip(" ")
    text = fields["street"] + (f" {fields['number']}" if fields.get("number") else "")
    if fields.get("floor") is not None or fields.get("door") is not None:
        text += ","
    text += f" {fields['floor']}." if fields.get("floor") else ""
    text += f" {fields['door']}" if fields.get("door") else ""
    text += ", " + (f"{fields['locality']}, " if fields.get("locality") else "") + (fields.get("postal") or "") + " " + (fields.get("city") or "")
    text = text.strip(" ")
    entries = [[raw[x] if x is not None else None, text[y] if y is not None else None] for x, y in plain_edits(raw, text)]
    names = [f for f in washing.FIELDS if fields.get(f)]
    got, unknown, at_blank = {}, [], True
    for k, name in enumerate(names):
        left, word = len(fields[name]), ""
        while entries:
            own, their = entries[0]
            if left == 0 and (their is not None or own in BLANK):
                break
            entries.pop(0)
            left -= their is not None
            if own is not None:
                word, at_blank = word + own, own in BLANK
        if entries and entries[0][1] is not None and strict(names, k, fields) and not at_blank:
            rest = []
            while entries and not (entries[0][0] is not None and entries[0][0] in BLANK):
                own, their = entries.pop(0)
                word += own or ""
                if their is not None:
                    rest.append([None, their])
            entries, at_blank = rest + entries, True
        got[name] = word
        while entries and (entries[0][1] is None or entries[0][1] in BLANK):
            own, their = entries[0]
            if own is None or own in BLANK:
                entries.pop(0)
                continue
            if their is None:
                ahead = next((e for e in entries if (e[0] is not None and e[0] in BLANK) or (e[1] is not None and e[1] not in BLANK)), None)
                if ahead is not None and not (ahead[0] is not None and ahead[0] in BLANK):
                    break
            token = ""
            while entries and not (entries[0][0] is not None and entries[0][0] in BLANK) and not (entries[0][1] is not None and entries[0][1] not in BLANK):
                token += entries.pop(0)[0] or ""
            unknown.append(token)
        at_blank = at_blank or bool(unknown)
    return got, unknown


def strict_end(names, k, fields):
    if names[k] != "floor" or k == len(names) - 1 or names[k + 1] != "door":
        return True
    return fields["floor"][-1].isdigit() and fields["door"][0].isdigit()


def washed(spark, rows):
    schema = "text string, " + ", ".join(f"{f} string" for f in washing.FIELDS)
    df = spark.createDataFrame([(r, *[c.get(f) for f in washing.FIELDS]) for r, c in rows], schema)
    return [(r.parsed.asDict(), r.text) for r in washing.with_fields(df, "text", {f: f for f in washing.FIELDS}).collect()]


CASES = [
    ("Aggustenborgade 5 C, 5.1 8000 Åhrus C", {"street": "Augustenborggade", "number": "5C", "floor": "5", "door": "1", "postal": "8000", "city": "Aarhus C"}, {"street": "Aggustenborgade", "number": "5C", "floor": "5", "door": "1", "postal": "8000", "city": "Åhrus C"}),
    ("Brøddegade 14, 14, Gudhjem, 3760 Gudhjem", {"street": "Brøddegade", "number": "14", "floor": "1", "door": "4", "locality": "Gudhjem", "postal": "3760", "city": "Gudhjem"}, None),
    ("Margrethepladsen 04, 04. 8000 Aarhus C", {"street": "Margrethepladsen", "number": "4", "floor": "4", "postal": "8000", "city": "Aarhus C"}, {"street": "Margrethepladsen", "number": "4", "floor": "4", "postal": "8000", "city": "Aarhus C"}),
    ("Højvangsvej 13, 8260 Viby J", {"street": "Højvangsvej", "number": "1", "locality": "Stavtrup", "postal": "8260", "city": "Viby J"}, {"street": "Højvangsvej", "number": "13", "locality": "", "postal": "8260", "city": "Viby J"}),
    ("foobar", {"street": "Road", "number": "1", "postal": "1000", "city": "Town"}, None),
    ("", {"street": "Road", "number": "1", "postal": "1000", "city": "Town"}, {"street": "", "number": "", "postal": "", "city": ""}),
    ("Road 1, behind the mill, 1000 Town", {"street": "Road", "number": "1", "postal": "1000", "city": "Town"}, {"street": "Road", "number": "1", "postal": "1000", "city": "Town"}),
]


def test_parts_of_known_texts(spark):
    for (raw, fields, want), (got, _) in zip(CASES, washed(spark, [(r, f) for r, f, _ in CASES]), strict=True):
        parts = {f: got[f] for f in fields}
        if want is not None:
            assert parts == want, (raw, parts)
        assert all(got[f] is None for f in washing.FIELDS if f not in fields)
    assert washed(spark, [CASES[-1][:2]])[0][0]["unknown"] == ["behind", "the", "mill"]


def test_parts_of_damaged_addresses_are_those_of_a_plain_walk(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1000):
        fields = {"street": rng.choice(["Nørregade", "Gl. Kongevej", "A P Møllers Allé", "Vej 12"]), "number": rng.choice(["1", "12B", "104", "7"])}
        fields |= {"floor": rng.choice(["st", "1", "12"])} if rng.random() < 0.5 else {}
        fields |= {"door": rng.choice(["tv", "4", "-12", "mf"])} if rng.random() < 0.5 else {}
        fields |= {"locality": rng.choice(["Stavtrup", "Ny By"])} if rng.random() < 0.3 else {}
        fields |= {"postal": rng.choice(["8000", "2100"]), "city": rng.choice(["Aarhus C", "Ø"])}
        raw = list(f"{fields['street']} {fields['number']}, {fields.get('floor', '')}. {fields.get('door', '')}, {fields['postal']} {fields['city']}")
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(raw) + 1)
            raw[at : at + rng.randint(0, 2)] = rng.choice(["", "x", " ", "foo ", ",", "1", " bar", ". "])
        rows.append(("".join(raw), fields))
    for (raw, fields), (got, _) in zip(rows, washed(spark, rows), strict=True):
        want, unknown = plain_parts(raw, fields, strict_end)
        want["number"] = want["number"].lstrip("0")
        if len(want["number"]) > 2 and want["number"][-2] == " " and want["number"][:-2].isdigit() and want["number"][-1].isascii() and want["number"][-1].isalpha():
            want["number"] = want["number"].replace(" ", "")
        if "floor" in want:
            want["floor"] = want["floor"].lstrip("0")
        assert ({f: got[f] for f in want}, got["unknown"]) == (want, unknown), (raw, fields)


def test_batches_align_like_single_pairs():
    rng = random.Random(4)
    pairs = [("".join(rng.choices("abA .,", k=rng.randint(0, 9))), "".join(rng.choices("abB .", k=rng.randint(0, 9)))) for _ in range(300)]
    for insert, update, delete in ((1, 2, 1), (1, 1, 1), (2, 3, 1)):
        a, an = washing.characters([x for x, _ in pairs])
        b, bn = washing.characters([y for _, y in pairs])
        own, other = washing.aligned(a, an, b, bn, insert, update, delete)
        for k, (x, y) in enumerate(pairs):
            got = [(int(p) if p >= 0 else None, int(q) if q >= 0 else None) for p, q in zip(own[k], other[k], strict=True) if p >= 0 or q >= 0]
            assert got == plain_edits(x, y, insert, update, delete), (x, y)


@pytest.fixture(scope="module")
def names(spark):
    rows = [(i, f"{a} {b} {i % 40}", f"{1000 + i % 7}") for i, (a, b) in enumerate((a, b) for _ in range(20) for a in ("north", "south", "old") for b in ("road", "street", "row"))]
    return spark.createDataFrame(rows, "id long, name string, postal string")


def test_index_finds_what_a_scan_finds(spark, names):
    index = search_index.built(names, "id", {"name": "A", "postal": "C"}, buckets=8)
    assert len(index.bounds) == 8
    for text in ("north road", "nor* ro*", "old 1003", "1*", "road 1*", "south row 3* 10*", "nothing here", "r* 2*"):
        terms = matching.terms(text)
        got = sorted(tuple(r) for r in search_index.found(index, terms).collect())
        want = sorted(tuple(r) for r in matching.match_scan(names, "id", {"name": "A", "postal": "C"}, text).collect())
        assert got == want, text
    assert search_index.split_terms([("road", False), ("1", True)]) == ([("road", False)], [("1", True)])
    assert search_index.split_terms([("1", True)]) == ([("1", True)], [])


def test_search_reads_the_buckets_of_its_terms_only(spark, names):
    index = search_index.built(names, "id", {"name": "A", "postal": "C"}, buckets=8)
    few = index.buckets([("north", False)])
    assert 0 < len(few) < 8
    plan = search_index.found(index, [("north", False)])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    sizes = index.postings.groupBy("bucket").count().agg(F.max("count"), F.avg("count")).first()
    assert sizes[0] <= 3 * sizes[1]  # a frequent term is spread


def test_wash_candidates_fall_back_to_near_streets(spark, names):
    index = search_index.built(names, "id", {"name": "A", "postal": "C"}, buckets=4)
    text = F.concat_ws(" ", "name", "postal")
    exact = search_index.wash_candidates(index, names, text, "name", "postal", "north road 1003").collect()
    assert exact and all(r.text.startswith("north road") and r.text.endswith("1003") for r in exact)
    near = search_index.wash_candidates(index, names, text, "name", "postal", "nroth roda 1003").collect()
    assert near and all(r.text.endswith("1003") for r in near) and near[0].text.startswith("north road")
    assert [r.edits for r in near] == sorted(r.edits for r in near)


def test_running_minimum_of_costs_is_the_table():
    a, _ = washing.characters(["kitten", "abc"])
    b, _ = washing.characters(["sitting", "cab"])
    assert washing.costs(a, b, 1, 1, 1)[7, 0, 6] == 3
    assert np.array_equal(washing.costs(a, b, 1, 2, 1)[3, 1], [3, 2, 1, 2, 3, 4, 5][:7])


def test_suggestions_of_addresses_with_two_postal_codes(spark):
    df = spark.createDataFrame([(1, "Vej", "4", "st", "tv", "By", "2100", "Kbh", "0999", "Stor")], "id int, street string, number string, floor string, door string, locality string, postal string, city string, own string, own_city string")
    fields = {f: f for f in washing.FIELDS}
    got = lambda q, **kw: [(r.text, r.suggestion, r.caret, r.large) for r in addresses.suggestions(df, fields, q, ("own", "own_city"), **kw).orderBy("place").collect()]
    plain, own = "Vej 4, st. tv, 2100 Kbh", "Vej 4, st. tv, 0999 Stor"
    assert got("vej") == [(plain, plain, len(plain), False), (own, own, len(own), True)]
    assert [r[3] for r in got("vej 0999")] == [True, False]
    assert [r[3] for r in got(plain)] == [False] and [r[3] for r in got(own)] == [True]
    long = "Vej 4, st. tv, By, 2100 Kbh"
    assert got("x", locality=True, multiline=True)[0] == (long, long.replace(", By, ", "\nBy\n"), len(long), False)
    open_end = got("x", locality=True, complete=False)[0]
    assert open_end == ("Vej 4, , By, 2100 Kbh", long, len("Vej 4, "), False)
    none = df.withColumn("own", F.lit(None).cast("string"))
    assert [r.large for r in addresses.suggestions(none, fields, "0999", ("own", "own_city")).collect()] == [False]


def test_synonyms_are_found_either_way_and_take_the_best_class(spark):
    df = spark.createDataFrame([(1, "Store Boulevard", "x"), (2, "Lille Vej", "boulevard"), (3, "Østre Allé", "")], "id long, name string, town string")
    groups = spark.createDataFrame([(["boulevard", "boulev", "boul"],), (["alle", "allee"],)], "synonyms array<string>")
    index = search_index.built(df, "id", {"name": "A", "town": "D"}, 4, groups)
    find = lambda q: {r.id: r.rank for r in search_index.found(index, matching.terms(spelling.asked(q))).collect()}
    ranks = find("boul")
    assert set(ranks) == {1, 2} and ranks[1] > ranks[2]
    assert set(find("Oestre allee")) == {3} and set(find("østre alle")) == {3} and find("nothing") == {}


def test_differences_and_grades(spark):
    schema = "k int, raw string, street string, number string, floor string, postal string, city string"
    rows = [(1, "Road 1, 1000 Town", "Road", "1", None, "1000", "Town"), (2, "Raod 1, 1000 Town", "Road", "1", None, "1000", "Town"), (3, "Road 2, 1000 Town", "Road", "1", None, "1000", "Town"), (4, "Road 1, 3., 1000 Town", "Road", "1", "3", "1000", "Town"), (5, "Road 1, xyz, 1000 Town", "Road", "1", None, "1000", "Town")]
    fields = {f: f for f in ("street", "number", "floor", "postal", "city")}
    got = {r.k: (r.category, r.total) for r in washing.graded(spark.createDataFrame(rows, schema), "raw", fields).collect()}
    assert got == {1: ("A", 0), 2: ("B", 2), 3: ("C", 1), 4: ("A", 0), 5: ("C", 0)}
    two = spark.createDataFrame([(7, "Road 1, 1000 Town", "Rode", "1", None, "1000", "Town", "b"), (7, "Road 1, 1000 Town", "Road", "1", None, "1000", "Town", "c"), (7, "Road 1, 1000 Town", "Road", "9", None, "1000", "Town", "a")], schema + ", id string")
    best = washing.washed(two, ["k"], "raw", fields, ["id"]).first()
    assert (best.id, best.category) == ("c", "A")


def test_terms_of_queries():
    assert matching.terms("Nørre* vej,2.tv") == [("nørre", True), ("vej", False), ("2", False), ("tv", False)]
    assert matching.terms("a*b ** * c***") == [("a", False), ("b", False), ("c", True)]
    assert matching.terms("ab c", True)[-1] == ("c", True) and matching.terms("ab c ", True)[-1] == ("c", False) and matching.terms("ab c,", True)[-1] == ("c", False)
    assert matching.terms("") == [] and matching.terms(" ,* ", True) == []


def test_one_file_of_many_rows_is_dealt_over_tasks(spark):
    from fieldbook.operators import geometry, search_index

    one = spark.range(0, 60_000, 1, 1).select(F.col("id").alias("k"), F.lit("Road 1").alias("street"), F.lit("road 1").alias("raw"), F.lit("Other").alias("second"), F.lit(None).cast(geometry.RINGS).alias("rings"))
    least = max(spark.sparkContext.defaultParallelism, 3)
    assert washing.with_fields(one, "raw", {"street": "street"}).rdd.getNumPartitions() >= least
    assert geometry.split(one, "k", "rings").rdd.getNumPartitions() >= 12
    best = washing.best_variant(one.limit(5), ["k"], "raw", {"street": ["street", "second"]}, {}, {"street": 1})
    assert sorted((r.k, r.variant_street) for r in best.collect()) == [(k, "road 1") for k in range(5)]
    twice = spark.createDataFrame([(1, "Mill Road mill", "Road"), (2, "", "x")], "k long, a string, b string")
    got = {r.k: [(x.token, x["class"]) for x in r.list] for r in twice.select("k", search_index.own_tokens({"a": "B", "b": "A"}).alias("list")).collect()}
    assert got == {1: [("mill", "B"), ("road", "A")], 2: [("x", "A")]}
