"""Registry queries about searching and washing addresses, on the driver's tables: part names are the street names."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.functions import text as tx
from fieldbook.operators import addresses, matching, relational, search_index, spelling, washing
from fieldbook.plans import Parameter, Resource
from fieldbook.queries import _TRI, big, query, t


@query("""SELECT lang, token, count(*) AS n FROM (SELECT doc_id, lang, unnest(list_distinct(list_filter(string_split_regex(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöøùúûüý', 'aaaaaaceeeeiiiinoooooouuuuy'), '[^a-z]+'), lambda w: length(w) > 3))) AS token FROM documents)
GROUP BY lang, token ORDER BY n DESC, lang, token LIMIT 50""")
def q_unaccented_tokens(spark, d):
    words = F.filter(F.array_distinct(F.split(tx.unaccented(F.col("text")), "[^a-z]+")), lambda w: F.length(w) > 3)
    return t(spark, d, "documents").select("lang", F.explode(words).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "token").limit(50)


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' THEN 3 ELSE 2 END AS n FROM part WHERE len(string_split(p_name, ' ')) = 2")
def q_synonym_tokens(spark, d):
    p = t(spark, d, "part").filter(F.size(F.split("p_name", " ")) == 2)
    return p.select("p_partkey", F.size(tx.with_synonyms(F.split("p_name", " "), {"widget": "gadget2"})).alias("n"))


_LINES = "l AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'no address ' || c_custkey ELSE 'Road of ' || lower(c_mktsegment) || ' ' || (1 + c_custkey % 200) || CASE WHEN c_custkey % 3 = 0 THEN 'B' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN ', 3. tv' ELSE '' END || ', ' || lpad(CAST(1000 + c_nationkey AS VARCHAR), 4, '0') || ' City' END AS line, c_mktsegment, c_nationkey FROM customer)"


def _lines(spark, d):
    c = t(spark, d, "customer")
    k = F.col("c_custkey")
    line = F.concat(F.lit("Road of "), F.lower("c_mktsegment"), F.lit(" "), (1 + k % 200).cast("string"), F.when(k % 3 == 0, "B").otherwise(""), F.when(k % 2 == 0, ", 3. tv").otherwise(""), F.lit(", "), F.lpad((1000 + F.col("c_nationkey")).cast("string"), 4, "0"), F.lit(" City"))
    return c.select("c_custkey", F.when(k % 5 == 0, F.concat(F.lit("no address "), k.cast("string"))).otherwise(line).alias("line"), "c_mktsegment", "c_nationkey")


@query(f"""WITH {_LINES} SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'Road of ' || lower(c_mktsegment) END AS street, CASE WHEN c_custkey % 5 <> 0 THEN (1 + c_custkey % 200) || CASE WHEN c_custkey % 3 = 0 THEN 'B' ELSE '' END END AS number,
CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN '3' END AS floor, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN 'tv' END AS door, CASE WHEN c_custkey % 5 <> 0 THEN CAST(1000 + c_nationkey AS VARCHAR) END AS postal FROM l""")
def q_address_parse(spark, d):
    return _lines(spark, d).select("c_custkey", tx.address_parts(F.col("line")).alias("a")).select("c_custkey", "a.street", "a.number", "a.floor", "a.door", "a.postal")


@query("""WITH h AS (SELECT c_custkey, 1 + c_custkey % 200 AS n, CASE c_custkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'C' ELSE '' END AS l FROM customer)
SELECT c_custkey FROM h WHERE (n > 12 OR (n = 12 AND l >= 'C')) AND (n < 40 OR (n = 40 AND l <= 'B'))""")
def q_house_range(spark, d):
    k = F.col("c_custkey")
    h = tx.house_number(F.concat((1 + k % 200).cast("string"), F.when(k % 3 == 0, "B").when(k % 3 == 1, "C").otherwise("")))
    return t(spark, d, "customer").filter(tx.house_number_between(h, tx.house_number(F.lit("12C")), tx.house_number(F.lit("40B")))).select("c_custkey")


@query(f"""WITH g AS (SELECT p_name, {_TRI.format('p_name')} AS a, {_TRI.format("'smal widgte'")} AS b FROM (SELECT DISTINCT p_name FROM part)), s AS (SELECT p_name FROM g ORDER BY round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6), p_name LIMIT 15)
SELECT p_partkey, p_name, CAST(levenshtein(p_name, 'smal widgte') AS BIGINT) AS edits FROM part WHERE p_name IN (SELECT p_name FROM s) AND p_size = 12 ORDER BY edits, p_partkey LIMIT 30""")
def q_address_candidates(spark, d):
    return addresses.fuzzy(t(spark, d, "part"), "p_name", "p_partkey", "smal widgte 12", narrow={"p_size": 12}).select("p_partkey", "p_name", "edits")


@query("""WITH c AS (SELECT p_partkey, p_name, p_size, levenshtein(p_name, 'small widget') AS street, abs(p_size - 12) AS number, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 3 END AS postal FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY postal IS NULL, coalesce(postal, 0), street, number, p_partkey) AS place FROM c ORDER BY place LIMIT 40""")
def q_wash_order(spark, d):
    k = F.col("p_partkey")
    rows = t(spark, d, "part").select("p_partkey", F.levenshtein(F.col("p_name"), F.lit("small widget")).alias("street"), F.abs(F.col("p_size") - 12).alias("number"), F.when(k % 4 != 0, k % 3).alias("postal"))
    best = addresses.by_relevance(rows, ["postal", "street", "number"], {"postal", "street", "number"}, ["p_partkey"]).limit(40)
    return best.withColumn("place", F.row_number().over(addresses.Window.orderBy(*addresses.relevance(["postal", "street", "number"], {"postal", "street", "number"}), "p_partkey")).cast("long")).select("p_partkey", "place")


@query("""WITH s AS (SELECT DISTINCT p_name FROM part), x AS (SELECT p_partkey, p_name, p_size, CASE WHEN p_name = 'small widget' THEN 0.0 ELSE 9.0 END + CASE WHEN p_size = 12 THEN 0.0 ELSE 9.0 END AS total, CASE WHEN p_size = 12 THEN 0.0 ELSE 9.0 END AS number FROM part)
SELECT p_partkey, CAST(total AS DOUBLE) AS total FROM x ORDER BY total, number, p_name, p_size, p_partkey LIMIT 25""")
def q_autocomplete_order(spark, d):
    p = t(spark, d, "part")
    scores = {"name": F.when(F.col("p_name") == "small widget", 0.0).otherwise(9.0), "number": F.when(F.col("p_size") == 12, 0.0).otherwise(9.0)}
    return addresses.ordered_results(p, scores, ["number"], ["p_name", "p_size", "p_partkey"]).limit(25).select("p_partkey", "total")


@query("""SELECT 'part' AS entity, CAST(p_partkey AS VARCHAR) AS id FROM (SELECT p_partkey FROM part WHERE starts_with(p_name, 'small w') ORDER BY p_partkey LIMIT 20)""")
def q_entity_cascade(spark, d):
    p = t(spark, d, "part")
    brands = p.select("p_brand").distinct()
    steps = [("brand", lambda: brands.filter(F.col("p_brand").startswith("small w")).orderBy("p_brand").select(F.col("p_brand").alias("id"))), ("part", lambda: p.filter(F.col("p_name").startswith("small w")).orderBy("p_partkey").select(F.col("p_partkey").cast("string").alias("id")))]
    return addresses.cascade(steps, least=1, size=20)


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ', st tv' WHEN 1 THEN 'Sal Road ' || c_custkey || ' , kl tv' WHEN 2 THEN 'Stuen Road 7, ' || c_custkey || '. . th sal' ELSE 'Road 1, Sal' END AS line FROM customer""")
def q_spoken_address(spark, d):
    k = F.col("c_custkey")
    line = F.when(k % 4 == 0, F.concat("c_name", F.lit(", StuePlan tv"))).when(k % 4 == 1, F.concat(F.lit("Sal Road "), k.cast("string"), F.lit(" , KLD tv"))).when(k % 4 == 2, F.concat(F.lit("Stuen Road 7, "), k.cast("string"), F.lit(". sal. th sal"))).otherwise("Road 1, Sal")
    return t(spark, d, "customer").select("c_custkey", tx.spoken(line).alias("line"))


@query("""WITH i AS (SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE '%small%' OR p_type LIKE '%SMALL%')
SELECT p_partkey, CASE WHEN p_name = 'small widget' THEN 2 WHEN p_name LIKE '%small%' THEN 1 ELSE 0 END AS named, CAST(levenshtein(p_name, 'small widget') AS BIGINT) AS edits FROM i ORDER BY named DESC, edits, p_partkey LIMIT 30""")
def q_name_first_rank(spark, d):
    p = t(spark, d, "part").filter(F.contains(F.col("p_name"), F.lit("small")) | F.contains(F.col("p_type"), F.lit("SMALL")))
    named = F.when(F.col("p_name") == "small widget", 2).when(F.contains(F.col("p_name"), F.lit("small")), 1).otherwise(0)
    return p.select("p_partkey", named.alias("named"), big(matching.difference(F.col("p_name"), F.lit("small widget"))).alias("edits")).orderBy(F.desc("named"), "edits", "p_partkey").limit(30)


# Washing: every customer as an address, and a raw text of it that is whole, has another letter in the street, an unknown word, or other case and zeros

_KNOWN = """a AS (SELECT c_custkey AS k, 'Road of ' || lower(c_mktsegment) AS street, (1 + c_custkey % 200) || CASE WHEN c_custkey % 3 = 0 THEN 'B' ELSE '' END AS number, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'st' ELSE CAST(c_custkey % 12 + 1 AS VARCHAR) END AS floor,
CASE WHEN c_custkey % 5 < 2 THEN 'tv' END AS door, CAST(1000 + c_nationkey AS VARCHAR) AS postal, 'Town ' || chr(CAST(65 + c_nationkey AS INTEGER)) AS city FROM customer)"""


def _known(spark, d):
    k = F.col("c_custkey")
    number = F.concat((1 + k % 200).cast("string"), F.when(k % 3 == 0, "B").otherwise(""))
    floor = F.when(k % 4 == 1, "st").when(k % 4 > 1, (k % 12 + 1).cast("string"))
    return t(spark, d, "customer").select(k.alias("k"), F.concat(F.lit("Road of "), F.lower("c_mktsegment")).alias("street"), number.alias("number"), floor.alias("floor"), F.when(k % 5 < 2, "tv").alias("door"), (1000 + F.col("c_nationkey")).cast("string").alias("postal"), F.concat(F.lit("Town "), F.char(65 + F.col("c_nationkey"))).alias("city"))


_PARTS = {f: f for f in washing.FIELDS if f != "locality"}


def _raw(spark, d):
    k, parts = F.col("k"), {f: F.col(f) if f in _PARTS else F.lit(None).cast("string") for f in washing.FIELDS}
    changed = {**parts, "street": F.concat(F.lit("Rxad"), F.substring("street", 5, 99))}
    spoken = {**parts, "number": F.concat(F.lit("0"), F.col("number"))}
    line = F.when(k % 7 == 1, washing.address_text(changed)).when(k % 7 == 2, F.concat(washing.address_text({**parts, "postal": F.lit(None).cast("string"), "city": F.lit(None).cast("string")}), F.lit("behind the mill, "), F.col("postal"), F.lit(" "), F.col("city"))).when(k % 7 == 3, F.lower(washing.address_text(spoken))).otherwise(washing.address_text(parts))
    return _known(spark, d).withColumn("raw", line)


@query(f"""WITH {_KNOWN} SELECT k, CASE k % 7 WHEN 1 THEN 'Rxad' || substr(street, 5) WHEN 3 THEN lower(street) ELSE street END AS street, CASE WHEN k % 7 = 3 THEN lower(number) ELSE number END AS number, floor, door, postal, CASE WHEN k % 7 = 3 THEN lower(city) ELSE city END AS city,
CASE WHEN k % 7 = 2 THEN 'behind the mill' ELSE '' END AS unknown FROM a""")
def q_address_fields(spark, d):
    got = washing.with_fields(_raw(spark, d), "raw", _PARTS)
    return got.select("k", *[F.col(f"parsed.{f}").alias(f) for f in _PARTS], F.array_join("parsed.unknown", " ").alias("unknown"))


@query(f"""WITH {_KNOWN} SELECT k, k AS best, CASE WHEN k % 7 = 1 THEN 'B' WHEN k % 7 = 2 THEN 'C' ELSE 'A' END AS category, CAST(CASE WHEN k % 7 = 1 THEN 1 ELSE 0 END AS BIGINT) AS total FROM a""")
def q_washed(spark, d):
    """Each raw text against its own address and that of the next customer, whose number differs."""
    raw = _raw(spark, d).select(F.col("k").alias("text_of"), "raw", F.explode(F.array("k", F.col("k") + 1)).alias("k"))
    best = washing.washed(raw.join(_known(spark, d), "k"), ["text_of"], "raw", _PARTS, ["k"])
    return best.select(F.col("text_of").alias("k"), F.col("k").alias("best"), "category", "total")


@query(f"""WITH {_KNOWN} SELECT k, CASE WHEN k % 2 = 0 THEN 'road' ELSE 'other road' END AS street, CASE WHEN k % 3 = 0 THEN '9999' ELSE postal END AS postal, CAST(CASE WHEN k % 5 = 0 THEN 11 ELSE 0 END AS DOUBLE) AS total FROM a""")
def q_best_variant(spark, d):
    """Rows with two street names and two postal codes; the text names one of each, and sometimes an unknown word."""
    k = F.col("k")
    rows = _known(spark, d).select("k", F.lit("Road").alias("street"), F.lit("Other Road").alias("second"), "number", "postal", F.lit("9999").alias("large"), "city")
    text = F.concat(F.when(k % 2 == 0, "road ").otherwise("other road "), F.lower("number"), F.when(k % 5 == 0, " zzz").otherwise(""), F.lit(", "), F.when(k % 3 == 0, F.col("large")).otherwise(F.col("postal")), F.lit(" "), F.lower("city"))
    best = washing.best_variant(rows.withColumn("text", text), ["k"], "text", {"street": ["street", "second"], "postal": ["postal", "large"]}, {"number": "number", "city": "city"}, {"street": 1, "number": 3, "postal": 3, "city": 1})
    return best.select("k", F.col("variant_street").alias("street"), F.col("variant_postal").alias("postal"), "total")


_WASH_TOKENS = "list_distinct(list_filter(string_split_regex(lower(street || ' ' || number || ' ' || postal || ' ' || city), '[^a-z0-9]+'), lambda w: w <> ''))"


@query(f"""WITH {_KNOWN}, w AS (SELECT k, street || ' ' || number || ', ' || postal || ' ' || city AS text, {_WASH_TOKENS} AS all_tokens FROM a),
m AS (SELECT k, text, len(all_tokens) AS n FROM w WHERE list_has_all(all_tokens, ['road', 'building', 'town']))
SELECT k, CAST(round(1000000 * 2.1 / (1.64493406685 * 3 * log2(n + 1))) AS BIGINT) AS rank, CAST(levenshtein(lower(text), 'road building, town') AS BIGINT) AS edits FROM m ORDER BY rank DESC, edits, k LIMIT 30""")
def q_wash_candidates(spark, d):
    rows = _known(spark, d)
    index = search_index.built(rows, "k", {"street": "A", "number": "B", "postal": "C", "city": "D"}, buckets=16)
    text = F.concat("street", F.lit(" "), "number", F.lit(", "), "postal", F.lit(" "), "city")
    return search_index.wash_candidates(index, rows, text, "street", "postal", "Road building, Town", costs=(1, 1, 1)).select("k", "rank", "edits")


@query(f"""WITH {_KNOWN}, w AS (SELECT k, {_WASH_TOKENS} AS x, list_distinct(string_split(lower(street), ' ')) AS s, number FROM a)
SELECT k, CAST(round(1000000 * (len(list_filter(s, lambda y: y = 'building' OR starts_with(y, '1'))) + 0.4 * CAST(starts_with(number, '1') AS INTEGER) + 0.2) / (1.64493406685 * 2 * log2(len(x) + 1))) AS BIGINT) AS rank FROM w WHERE list_contains(x, 'building') AND len(list_filter(x, lambda y: starts_with(y, '1'))) > 0 ORDER BY rank DESC, k LIMIT 50""")
def q_two_step_search(spark, d):
    """A word that narrows and a prefix that nearly every row has: the prefix is tested on what the word finds."""
    index = search_index.built(_known(spark, d), "k", {"street": "A", "number": "B", "postal": "C", "city": "D"}, buckets=16)
    return search_index.found(index, matching.terms("building 1*")).orderBy(F.desc("rank"), "k").limit(50)


@query("SELECT c_custkey, ' ' || CASE WHEN length(CAST(c_custkey * 9 AS VARCHAR)) < 4 THEN lpad(CAST(c_custkey * 9 AS VARCHAR), 4, '0') ELSE CAST(c_custkey * 9 AS VARCHAR) END AS code FROM customer")
def q_postal_blank(spark, d):
    return t(spark, d, "customer").select("c_custkey", tx.postal_blank(F.col("c_custkey") * 9).alias("code"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '10. Februar Vej' WHEN 1 THEN 'Road' WHEN 2 THEN 'Road' ELSE 'P. Lane''s Way' END AS street, CASE c_custkey % 4 WHEN 0 THEN '3' WHEN 1 THEN '12 B' WHEN 2 THEN '12' ELSE '7c' END AS number,
CASE c_custkey % 4 WHEN 2 THEN 'st' WHEN 3 THEN 'kl' END AS floor, CASE c_custkey % 4 WHEN 2 THEN 'th' END AS door, CASE c_custkey % 4 WHEN 1 THEN 'North' END AS locality, CAST(1000 + c_nationkey AS VARCHAR) AS postal, 'Town' AS city FROM customer""")
def q_strict_address(spark, d):
    k = F.col("c_custkey")
    start = F.when(k % 4 == 0, "10. Februar Vej 3, ").when(k % 4 == 1, "Road 12 B, North, ").when(k % 4 == 2, "Road 12,st. th,").otherwise("P. Lane's Way 7c, kl., ")
    line = F.concat(start, (1000 + F.col("c_nationkey")).cast("string"), F.lit(" Town"))
    return t(spark, d, "customer").select("c_custkey", tx.address_parts(line).alias("a")).select("c_custkey", "a.*")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS utc FROM events")
def q_iso_utc(spark, d):
    """The same instants whatever the session's zone; the table holds UTC times without one."""
    e = t(spark, d, "events").select("event_id", F.expr("make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), extract(second from ts), 'UTC')").alias("ts"))
    return e.select("event_id", tx.iso_utc(F.col("ts")).alias("utc"))


@query(f"""WITH {_KNOWN}, f AS (SELECT k, street || ' ' || number || CASE WHEN floor IS NOT NULL OR door IS NOT NULL THEN ',' ELSE '' END || coalesce(' ' || floor || '.', '') || coalesce(' ' || door, '') AS line, street || ' ' || number || ', ' AS head, postal, city, CASE WHEN k % 3 = 0 THEN '0999' END AS large FROM a),
s AS (SELECT k, head, line || ', ' || postal || ' ' || city AS plain, line || ', 0999 Large' AS own, line || chr(10) || postal || ' ' || city AS p2, line || chr(10) || '0999 Large' AS o2, large, postal, city FROM f)
SELECT k, head || ', ' || postal || ' ' || city AS text, p2 AS suggestion, length(head) AS caret, false AS large, CASE WHEN large IS NOT NULL THEN 1 ELSE 0 END AS place FROM s UNION ALL SELECT k, head || ', ' || postal || ' ' || city, o2, length(head), true, 0 FROM s WHERE large IS NOT NULL""")
def q_suggestions(spark, d):
    """Addresses as suggestions with room for floor and door; every third has a postal code of its own, which the query names."""
    rows = _known(spark, d).withColumn("own", F.when(F.col("k") % 3 == 0, "0999")).withColumn("own_city", F.lit("Large"))
    return addresses.suggestions(rows, _PARTS, "road 0999", ("own", "own_city"), multiline=True, complete=False).select("k", "text", "suggestion", "caret", "large", "place")


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS x FROM part), m AS (SELECT p_partkey, len(list_distinct(list_concat(x, CASE WHEN list_contains(x, 'small') THEN ['smaal'] ELSE [] END, CASE WHEN list_contains(x, 'widget') THEN ['vidget', 'gadget'] ELSE [] END))) AS n FROM w WHERE list_contains(x, 'small') AND list_contains(x, 'widget'))
SELECT p_partkey, CAST(round(1000000 * 2.0 / (1.64493406685 * 2 * log2(n + 1))) AS BIGINT) AS rank FROM m""")
def q_synonym_search(spark, d):
    """Parts found by another spelling and by a synonym of their words, special letters written out."""
    groups = spark.createDataFrame([(["small", "smaal"],), (["widget", "vidget", "gadget"],)], "synonyms array<string>")
    index = search_index.built(t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", {"p_name": "A"}, 16, groups)
    return search_index.found(index, matching.terms(spelling.asked("Smål gadget"))).select("p_partkey", "rank")


@query("""SELECT r_name, CAST(to_json(list({'key': n_nationkey, 'name': n_name, 'note': CASE WHEN n_nationkey % 2 = 0 THEN n_name END} ORDER BY n_name)) AS VARCHAR) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name""")
def q_nested_json(spark, d):
    n = t(spark, d, "nation").withColumn("note", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))
    made = relational.nested_json(n, ["n_regionkey"], {"key": "n_nationkey", "name": "n_name", "note": "note"}, ["n_name"], "nations")
    return t(spark, d, "region").join(made, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "nations")


@query("WITH h AS (SELECT c_custkey, (1 + c_custkey % 200) || CASE c_custkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'C' ELSE '' END AS h FROM customer) SELECT c_custkey FROM h WHERE h IN ('12C', '40', '7B', '100')")
def q_house_numbers_in(spark, d):
    """House numbers that are one of several; text that is none is nobody's."""
    k = F.col("c_custkey")
    h = tx.house_number(F.concat((1 + k % 200).cast("string"), F.when(k % 3 == 0, "B").when(k % 3 == 1, "C").otherwise("")))
    return t(spark, d, "customer").where(tx.house_number_in(h, ["12c", "40", "7B", "100", "no number", "1234"])).select("c_custkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderkey LIMIT 20")
def q_parameters_by_default(spark, d):
    """A parameter under its older name, one by its default, and the first page that autocomplete has."""
    resource = Resource(["o_orderkey"], {"status": Parameter("o_orderstatus", default="O"), "priority": Parameter("o_orderpriority", renamed=("prio",))})
    return resource.query(t(spark, d, "orders"), {"prio": "1-URGENT|2-HIGH"}, validate=True, autocomplete=True).select("o_orderkey", "o_orderstatus")
