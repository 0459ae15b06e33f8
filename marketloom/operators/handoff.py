"""The hand-off: a queued lead with its company, contact and evidence, the checks of its copy, and the lead as one document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T

#: Words of the two emails and characters of the note, at most.
EMAIL_1_WORDS, EMAIL_2_WORDS, NOTE_CHARS = 90, 60, 300
#: Informal words by language, and countries by code.
INFORMAL = {"fr": ("tu", "ton", "ta", "tes", "toi"), "de": ("du", "dich", "dir", "dein", "deine")}
COUNTRIES = {"FR": "France", "DE": "Germany", "ES": "Spain", "IT": "Italy", "BE": "Belgium"}
#: The columns of a company's row and of a contact's.
COMPANY_COLUMNS = (
    "Company name", "Company Domain Name", "Company phone", "Street Address", "City", "Postal Code", "Country/Region", "Number of Employees", "icp_score", "icp_tier",
    "icp_queue_rank", "icp_reason", "icp_evidence", "icp_group_sirens", "rge_email", "icp_registry_name", "seq_1_subject", "seq_1_body", "seq_2_body", "seq_3_linkedin",
)
CONTACT_COLUMNS = ("Company Domain Name", "First Name", "Last Name", "Job Title")
OFFICERS = "array<struct<type_dirigeant:string,nom:string,prenoms:string,date_de_naissance:string,qualite:string,siren:string,denomination:string>>"


@dataclass(frozen=True)
class Outreach:
    vendor: str = "Marketloom"
    language: str = "fr"
    country: str = "FR"


def contact(managers: Column) -> Column:
    """struct(first_name, last_name, role, role_en) of the first person among the officers (JSON) who is no auditor and has a surname."""
    people = F.transform(F.from_json(F.coalesce(managers, F.lit("[]")), OFFICERS), lambda o: F.struct(o["type_dirigeant"].alias("kind"), F.split(F.trim(F.coalesce(o["prenoms"], F.lit(""))), r"[\s,]+")[0].alias("first"), F.trim(F.split(F.coalesce(o["nom"], F.lit("")), r"\(")[0]).alias("last"), F.coalesce(o["qualite"], F.lit("")).alias("role")))
    fit = F.filter(people, lambda o: (o["kind"] == "personne physique") & ~F.upper(o["role"]).contains("COMMISSAIRE AUX COMPTES") & (o["last"] != ""))
    one = F.try_element_at(fit, F.lit(1))
    return F.when(one.isNotNull(), F.struct(T.titled(one["first"]).alias("first_name"), T.titled(one["last"]).alias("last_name"), one["role"].alias("role"), T.role_en(one["role"]).alias("role_en")))


def evidence_items(signals: DataFrame, cfg: Config) -> DataFrame:
    """(gid, n, signal, quote, quote_en, url): every piece of a lead's found signals, numbered from 1 in the config's order of signals."""
    order = F.array(*(F.lit(s.id) for s in cfg.signals))
    one = signals.where("found").groupBy("gid").agg(F.array_sort(F.collect_list(F.struct(F.when(F.array_position(order, F.col("signal")) > 0, F.array_position(order, F.col("signal"))).otherwise(99).alias("ord"), "signal", "evidence"))).alias("s"))
    flat = F.flatten(F.transform("s", lambda s: F.transform(s["evidence"], lambda e: F.struct(s["signal"].alias("signal"), e["quote"].alias("quote"), e["quote_en"].alias("quote_en"), e["url"].alias("url")))))
    return one.select("gid", F.posexplode(flat).alias("n", "e")).select("gid", (F.col("n") + 1).alias("n"), "e.*")


def top_quotes(signals: DataFrame, cfg: Config) -> DataFrame:
    """(gid, quotes): a line for each found signal with evidence, in the config's order."""
    label = F.create_map(*(F.lit(x) for s in cfg.signals for x in (s.id, s.label)))
    rank = F.create_map(*(F.lit(x) for i, s in enumerate(cfg.signals) for x in (s.id, i)))
    first = F.col("evidence")[0]
    line = F.concat(F.coalesce(label[F.col("signal")], "signal"), F.lit(": «"), first["quote"], F.lit("» ("), first["quote_en"], F.lit(") "), first["url"])
    some = signals.where(F.col("found") & (F.size("evidence") > 0)).select("gid", F.struct(F.coalesce(rank[F.col("signal")], F.lit(99)).alias("ord"), line.alias("line")).alias("x"))
    return some.groupBy("gid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("quotes"))


def rows(leads: DataFrame, outreach: Outreach | None = None) -> DataFrame:
    """The company's and the contact's columns of each lead: gid, name, score, tier, queue_rank, reason_en, headcount, members, domain, quotes, phones,
    emails, address, postcode, managers (JSON) and, where it was drafted, sequence (struct of texts)."""
    o = outreach or Outreach()
    street, city = T.split_address(F.coalesce("address", F.lit("")), F.coalesce("postcode", F.lit("")))
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    has = "sequence" in leads.columns
    said = lambda c: F.coalesce(F.col("sequence")[c], F.lit("")) if has else F.lit("")
    person = F.col("person")
    values = {
        "Company name": T.display_name(F.col("name")), "Company Domain Name": F.coalesce("domain", F.lit("")), "Company phone": first("phones"), "Street Address": street, "City": T.titled(city),
        "Postal Code": F.coalesce("postcode", F.lit("")), "Country/Region": F.lit(COUNTRIES.get(o.country, o.country)), "Number of Employees": F.coalesce(F.rint("headcount").cast("long").cast("string"), F.lit("")),
        "icp_score": T.fixed(F.col("score"), 2), "icp_tier": F.col("tier"), "icp_queue_rank": F.col("queue_rank").cast("string"), "icp_reason": F.col("reason_en"), "icp_evidence": F.coalesce("quotes", F.lit("")),
        "icp_group_sirens": F.array_join("members", "; "), "rge_email": first("emails"), "icp_registry_name": F.col("name"),
        "seq_1_subject": said("email_1_subject"), "seq_1_body": said("email_1_body"), "seq_2_body": said("email_2_body"), "seq_3_linkedin": said("linkedin"),
        "First Name": F.coalesce(person["first_name"], F.lit("")), "Last Name": F.coalesce(person["last_name"], F.lit("")), "Job Title": F.coalesce(person["role"], F.lit("")),
    }
    return leads.withColumn("person", contact(F.col("managers"))).select(*(v.alias(k) for k, v in values.items()))


def contact_rows(rows: DataFrame) -> DataFrame:
    """Rows that have a domain and any name: others can't be told to a company, or are refused."""
    return rows.where((F.col("`Company Domain Name`") != "") & ((F.col("`First Name`") != "") | (F.col("`Last Name`") != ""))).select(*(f"`{c}`" for c in CONTACT_COLUMNS))


def own_domains(candidates: DataFrame, directories: DataFrame) -> DataFrame:
    """(gid, domain) of candidates (gid, place, url): of a group's websites in order of place, the host of the first that has one and is no directory
    (host); null if there is none. The agent's site comes first, then those of the lead company, then those of other members."""
    hosts = candidates.select("gid", "place", T.website_host(F.col("url")).alias("host"))
    fits = hosts.where("host IS NOT NULL").join(directories.select("host").distinct(), "host", "left_anti")
    best = fits.groupBy("gid").agg(F.min_by("host", F.struct("place", "host")).alias("domain"))
    return candidates.select("gid").distinct().join(best, "gid", "left")


#: What is said of a broken rule, and what counts as a score or tier.
TOO_LONG, TOO_MANY, NO_ITEM, TOO_FAMILIAR, SHOWN, UNNAMED = " words (limit {})", " characters (limit {})", " is no evidence item", "informal address: ", "a score or tier in the copy", " not named"
SCORE_OR_TIER = r"(?i)\b(score|scoring|tier|rubri\w*)\b|\b\d+(?:[.,]\d+)?\s*/\s*10\b"


def copy_flags(sequence: Column, numbers: Column, score: Column, outreach: Outreach | None = None) -> Column:
    """What breaks a rule in a drafted sequence. numbers: of the lead's evidence items; score: a text with one decimal, or null."""
    o = outreach or Outreach()
    copy = F.array(*(sequence[c] for c in ("email_1_subject", "email_1_body", "email_2_body", "linkedin")))
    flags = []
    for name, most in (("email_1_body", EMAIL_1_WORDS), ("email_2_body", EMAIL_2_WORDS)):
        n = T.n_words(sequence[name])
        flags.append(F.when(n > most, F.concat(F.lit(f"{name}: "), n.cast("string"), F.lit(TOO_LONG.format(most)))))
    n = F.length(sequence["linkedin"])
    flags.append(F.when(n > NOTE_CHARS, F.concat(F.lit("linkedin: "), n.cast("string"), F.lit(TOO_MANY.format(NOTE_CHARS)))))
    hook = sequence["hook_evidence"]
    flags.append(F.when(~F.array_contains(numbers, hook), F.concat(F.lit("hook_evidence "), hook.cast("string"), F.lit(NO_ITEM))))
    words = F.flatten(F.transform(copy, lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"((?U)\w+)"), F.lit(1))))
    informal = F.array_sort(F.array_intersect(F.array_distinct(words), F.array(*map(F.lit, INFORMAL.get(o.language, ()))).cast("array<string>")))
    flags.append(F.when(F.size(informal) > 0, F.concat(F.lit(TOO_FAMILIAR), F.array_join(informal, ", "))))
    shown = lambda t: t.rlike(SCORE_OR_TIER) | F.coalesce(t.contains(score) | t.contains(F.replace(score, F.lit("."), F.lit(","))), F.lit(False))
    flags.append(F.when(F.exists(copy, shown), F.lit(SHOWN)))
    flags.append(F.when(~F.exists(copy, lambda t: F.lower(t).contains(o.vendor.lower())), F.lit(o.vendor + UNNAMED)))
    return F.array_compact(F.array(*flags))


def lead_cards(scored: DataFrame, signals: DataFrame, market: DataFrame, grades: DataFrame, research: DataFrame, cfg: Config) -> DataFrame:
    """One nested document a lead: what the screen of a lead shows, signals in the config's order. scored: gid, name, score, tier, rank, queue_rank,
    is_reference, reason_en, headcount, headcount_source and a column a signal; research: gid, website, facts, notes_en, headcount_basis_en."""
    rank = F.create_map(*(F.lit(x) for i, s in enumerate(cfg.signals) for x in (s.id, i)))
    values = scored.select("gid", F.explode(F.create_map(*(x for s in cfg.signals for x in (F.lit(s.id), F.col(s.id))))).alias("signal", "final"))
    one = signals.join(values, ["gid", "signal"], "left").join(grades.select("gid", "signal", "basis_en"), ["gid", "signal"], "left")
    item = F.struct(rank[F.col("signal")].alias("ord"), "signal", F.col("value").alias("agent_value"), F.coalesce("final", "value").alias("value"), F.col("basis_en").alias("regrade_basis_en"), "found", "rationale_en", "evidence", "flags")
    nested = one.groupBy("gid").agg(F.array_sort(F.collect_list(item), lambda a, b: F.coalesce(a["ord"], F.lit(99)) - F.coalesce(b["ord"], F.lit(99))).alias("signals"))
    about = market.select("gid", "region", F.col("member_names").alias("members"))
    heads = ("gid", "name", "score", "tier", "rank", "queue_rank", "is_reference", "reason_en", "headcount", "headcount_source")
    return scored.select(*heads).join(about, "gid", "left").join(research, "gid", "left").join(nested, "gid", "left").withColumn("name", T.display_name(F.col("name")))


def lead_card(cards: DataFrame, gid: str) -> dict:
    """One lead's document; a lead that is not there is an error."""
    found = cards.where(F.col("gid") == gid).take(1)
    if not found:
        raise KeyError(f"{gid} was not researched")
    return found[0].asDict(recursive=True)


def named(market: DataFrame, wanted: list[str], key: str = "gid") -> DataFrame:
    """Rows of the groups named; one that the market doesn't have is an error. The names are a person's list."""
    asked = market.sparkSession.createDataFrame([(x,) for x in wanted], f"{key} string").distinct()
    missing = sorted(r[0] for r in asked.join(market, key, "left_anti").select(key).toLocalIterator())
    if missing:
        raise ValueError(f"the market doesn't have: {', '.join(missing)}")
    return market.join(asked, key, "left_semi")
