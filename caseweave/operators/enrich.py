"""What small dimension tables and further checks add: look-alike infrastructure, places, names, forged sign-ins, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.operators.audit import one_of

# What a forged sign-in has in place of an application or resource.
FORGED_NAMES = ("notapplicable", "not applicable", "notset", "not set", "")
FORGED_RESOURCE = "urn:federation:microsoftonline"
FORGED_ISSUER = "federated (adfs)"
FORGED_METHOD = "forms authentication"
# Words of networks that are known for abuse.
ABUSE_NETWORKS = ("bulletproof", "bpo", "flokinet", "ded", "stark industries", "railnet", "chang way", "pq hosting", "mivocloud", "aeza")
# Words of company names that say nothing about a person.
COMPANY_WORDS = ("the", "and", "company", "inc", "llc", "ltd")
DEVICE_LOGIN = r"(?i)(https?://)?(www\.)?(microsoft\.com/devicelogin|login\.microsoftonline\.com/common/oauth2/deviceauth|aka\.ms/devicelogin)"
LABELLED_CODE = r"(?i)code\s*(?:is|:)?\s*:?\s*([A-Z0-9]{8,9}|[A-Z0-9]{4}-[A-Z0-9]{4})\b"


def looks_forged(app: Column, resource: Column, resource_id: Column, issuer: Column, method: Column) -> Column:
    """At least one decisive marker (no application, no resource, the federation resource), and two in all."""
    def low(c: Column) -> Column:
        return F.lower(F.trim(F.coalesce(c, F.lit(""))))

    strong = low(app).isin(*FORGED_NAMES).cast("int") + low(resource).isin(*FORGED_NAMES).cast("int") + (low(resource_id) == FORGED_RESOURCE).cast("int")
    weak = (low(issuer) == FORGED_ISSUER).cast("int") + (low(method) == FORGED_METHOD).cast("int")
    return (strong >= 1) & (strong + weak >= 2)


def lookalike_infrastructure(messages: DataFrame, victims: tuple[str, ...], compromise_day: int | None, window_days: int = 90) -> DataFrame:
    """For each domain that looks like another and whose age is known: messages, age, score, indicated.
    messages: domain, lookalike_of, age_days (null if unknown), day."""
    g = messages.filter("lookalike_of <> '' AND age_days >= 0 AND domain <> ''").groupBy("domain").agg(
        F.min("lookalike_of").alias("resembles"), F.count("*").alias("messages"), F.min("age_days").alias("age_days"), F.min("day").alias("first_day"))
    young = F.when(F.col("age_days") < 30, 4).when(F.col("age_days") < window_days, 2).otherwise(0)
    young = F.when(F.col("age_days") < window_days, young).otherwise(0)
    like = F.when(one_of("resembles", tuple(v.lower() for v in victims)), 4).otherwise(2)
    made = F.col("first_day") - F.col("age_days")
    near = F.lit(0) if compromise_day is None else F.when(made.between(compromise_day - window_days, compromise_day + window_days), 3).otherwise(0)
    score = young + like + F.coalesce(near, F.lit(0))
    return g.withColumn("score", score.cast("long")).withColumn("indicated", F.col("score") >= 6)


def name_mismatch(name: Column, address: Column) -> Column:
    """A display name of two words or more, none of which is in the address's local part."""
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([a-z]{3,})"), F.lit(1))
    local = F.lower(F.substring_index(F.coalesce(address, F.lit("")), "@", 1))
    telling = F.filter(words, lambda w: ~w.isin(*COMPANY_WORDS))
    return (local != "") & (F.size(words) >= 2) & (F.size(telling) > 0) & ~F.exists(telling, lambda w: local.contains(w))


def contact_names(messages: DataFrame) -> DataFrame:
    """name, addresses of each display name that was seen."""
    return messages.filter("sender_name <> '' AND sender <> ''").groupBy(F.lower(F.trim("sender_name")).alias("name")).agg(F.array_sort(F.collect_set(F.lower("sender"))).alias("addresses"))


def display_name_spoof(messages: DataFrame, internal: DataFrame) -> DataFrame:
    """path, name: messages from outside under a name that an internal address (domain in internal) has used."""
    known = internal.select(F.col("domain").alias("d")).distinct()
    inside = messages.join(known, F.col("sender_domain") == F.col("d"), "left_semi")
    names = contact_names(inside).select(F.col("name").alias("known"))
    outside = messages.join(known, F.col("sender_domain") == F.col("d"), "left_anti").filter("sender_name LIKE '% %'")
    return outside.withColumn("name", F.lower(F.trim("sender_name"))).join(names, F.col("name") == F.col("known"), "left_semi").select("path", "name")


def device_code_lure(text: Column) -> Column:
    """A struct url, code if a text sends its reader to the device login page, else null; code may be empty."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract(t, DEVICE_LOGIN, 0)
    return F.when(found != "", F.struct(found.alias("url"), F.upper(F.regexp_extract(t, LABELLED_CODE, 1)).alias("code")))


def geo_findings(hops: DataFrame, expected: tuple[str, ...], networks: tuple[str, ...] = ABUSE_NETWORKS) -> DataFrame:
    """path, weight, countries: messages that came through an unexpected country (+2) or a network known for abuse (+4).
    hops: path, ip, country, org."""
    bad = F.lit(False)
    for n in networks:
        bad |= F.lower(F.coalesce("org", F.lit(""))).contains(n)
    odd = (F.coalesce("country", F.lit("")) != "") & ~F.upper("country").isin([c.upper() for c in expected]) if expected else F.lit(False)
    g = hops.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set(F.when(odd, F.upper("country")))), ",").alias("countries"), F.bool_or(bad).alias("abusive"))
    w = F.when(F.col("countries") != "", 2).otherwise(0) + F.when(F.col("abusive"), 4).otherwise(0)
    return g.select("path", w.alias("weight"), "countries", "abusive").filter("weight > 0")


def address_countries(activity: DataFrame, history: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """ip, country, unexpected, basis: audit addresses against their users' own sign-in countries, else against the expected.
    activity: ip, user, country; history: user, country."""
    h = history.select(F.lower("user").alias("u"), F.upper("country").alias("c")).distinct()
    a = activity.filter("country <> ''").select("ip", F.lower("user").alias("user"), F.upper("country").alias("country")).distinct()
    users = h.select(F.col("u").alias("hu")).distinct().withColumn("has", F.lit(True))
    x = a.join(users, a["user"] == users["hu"], "left").join(h.withColumn("seen", F.lit(True)), (a["user"] == h["u"]) & (a["country"] == h["c"]), "left")
    g = x.groupBy("ip", "country").agg(F.bool_or(F.coalesce("has", F.lit(False))).alias("has"), F.bool_or(F.coalesce("seen", F.lit(False))).alias("seen"))
    other = ~F.col("country").isin([c.upper() for c in expected]) if expected else F.lit(False)
    return g.select("ip", "country", F.when(F.col("has"), ~F.col("seen")).otherwise(other).alias("unexpected"), F.when(F.col("has"), "user").when(F.lit(bool(expected)), "global").otherwise("").alias("basis"))


def _marked(mark: str, texts: Column) -> Column:
    return F.transform(texts, lambda x: F.concat(F.lit(mark), x))


def config_drift(rules: DataFrame, recorded: DataFrame, internal: tuple[str, ...]) -> DataFrame:
    """name, external: concealing rules that nothing in the audit log explains by what they do. rules and recorded: name, forwards,
    words, move_to; rules also conceals. Rules meet by what they do (an address, a word, a folder), not all with all."""
    none = F.array().cast("array<string>")
    does = F.array_distinct(F.concat(*[_marked(k, F.coalesce(c, none)) for k, c in (("f:", F.col("forwards")), ("w:", F.col("words")), ("m:", F.filter(F.array(F.lower("move_to")), lambda x: x != "")))]))
    keys = recorded.select(F.explode(does).alias("key")).distinct()
    numbered = rules.filter("conceals").withColumn("__n", F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rules.columns]))))
    known = numbered.select("__n", F.explode(does).alias("key")).join(keys, "key", "left_semi").select("__n").distinct()
    left = numbered.join(known, "__n", "left_anti")
    return left.select("name", F.exists("forwards", lambda a: ~F.substring_index(a, "@", -1).isin(*internal) if internal else F.lit(True)).alias("external"))


def delegations(permissions: DataFrame, internal: tuple[str, ...]) -> DataFrame:
    """mailbox, user, external: grants that let another read or send. permissions: mailbox, user, rights."""
    strong = F.lower("rights").rlike("fullaccess|sendas|sendonbehalf|readpermission")
    domain = F.when(F.col("user").contains("@"), F.lower(F.substring_index("user", "@", -1))).otherwise("")
    return permissions.filter(strong).select("mailbox", "user", ((domain != "") & (~domain.isin(*internal) if internal else F.lit(True))).alias("external"))
