"""Facts of a district's forecast: every number and name that a text may show, formatted for three languages, with its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutoffs.functions import text as T

#: The bulletin and the ensemble in each language.
BULLETIN = {"en-IN": "IMD National Bulletin No. {no} issued {at}", "te-IN": "IMD జాతీయ బులెటిన్ నం. {no} ({at})", "hi-IN": "IMD राष्ट्रीय बुलेटिन सं. {no} ({at})"}
SHORT_BULLETIN = {"en-IN": "IMD Bulletin {no}", "te-IN": "IMD బులెటిన్ {no}", "hi-IN": "IMD बुलेटिन {no}"}
ENSEMBLE = {
    "en-IN": "{n} storm futures (ECMWF and Google DeepMind WeatherNext, aligned to the IMD track)",
    "te-IN": "{n} తుఫాను అంచనా మార్గాలు (ECMWF, Google DeepMind WeatherNext; IMD ట్రాక్‌కు అనుగుణంగా)",
    "hi-IN": "{n} तूफ़ान पूर्वानुमान मार्ग (ECMWF, Google DeepMind WeatherNext; IMD ट्रैक से संरेखित)",
}
OFFICIAL = "IMD"
_HEAD = "district_scenario"


def _fact(fid: Column, kind: str, unit: str | None, required: Column | bool, texts: dict[str, Column], table: str, row: Column | str, when: Column | None = None) -> Column:
    """A fact as a struct, null where it does not apply."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    names = {"en-IN": "en", "te-IN": "te", "hi-IN": "hi"}
    out = F.struct(
        fid.alias("fact_id"),
        F.lit(kind).alias("kind"),
        F.lit(unit).cast("string").alias("unit"),
        lit(required).alias("required"),
        *[texts[lang].cast("string").alias(names[lang]) for lang in T.LANGS],
        F.lit(table).alias("source_table"),
        lit(row).cast("string").alias("row_id"),
    )
    return out if when is None else F.when(F.coalesce(when, F.lit(False)), out)


def _per_lang(f) -> dict[str, Column]:
    return {lang: f(lang) for lang in T.LANGS}


def _rows(df: DataFrame, keys: list[str], part: int, order: Column, facts: list[Column]) -> DataFrame:
    out = df.select(*keys, order.alias("_order"), F.posexplode(F.array_compact(F.array(*facts))).alias("_pos", "f"))
    return out.select(*keys, F.lit(part).alias("part"), F.col("_order").cast("long").alias("item"), F.col("_pos").alias("pos"), "f.*")


def build_facts(scenarios: DataFrame, facilities: DataFrame, actions: DataFrame, n_facilities: int = 5, n_actions: int = 3) -> DataFrame:
    """(run_id, district, part, item, pos, fact_id, kind, unit, required, en, te, hi, source_table, row_id), ordered by part, item, pos.

    scenarios: run_id, district, district_name, mode, bulletin_no, issued_at, landfall_text, members MAP of sources to
    numbers, pop_p10, pop_p50, pop_p90, fac_p10, fac_p50, fac_p90. facilities: run_id, district, facility_id, type, name,
    simulated, p, t10, t90. actions: run_id, district, rank, action_id, crossing, road, place, place_te, place_hi,
    deadline, basis, people, p_event. The n_facilities with the largest p and the first n_actions of each scenario give
    facts; probabilities and ranges only those of an ensemble. Ties of p are in the order of the facility's id.
    """
    keys = ["run_id", "district"]
    ens = F.col("mode") == "ensemble"
    count = lambda c: F.col(c).cast("long").cast("string")
    both = lambda a, b, f: _per_lang(lambda lang: T.range_text(f(a, lang), f(b, lang), lang))
    people = lambda c, lang: T.people(F.col(c), lang)
    plain = lambda c, lang: count(c)
    names = F.create_map(*[x for k, v in T.DISTRICTS.items() for x in (F.lit(k), F.struct(*[F.lit(v[lang]).alias(lang) for lang in T.LANGS[1:]]))])
    local = lambda lang: F.col("district_name") if lang == "en-IN" else F.coalesce(F.try_element_at(names, F.col("district_name"))[lang], F.col("district_name"))
    members = F.aggregate(F.map_entries(F.map_filter("members", lambda k, v: k != OFFICIAL)), F.lit(0).cast("long"), lambda a, x: a + x["value"])
    quoted = F.concat(F.lit("“"), F.col("landfall_text"), F.lit("” (IMD)"))
    prov = f"{_HEAD}.provenance"
    head = f"{_HEAD}.headline"
    of_scenario = [
        _fact(F.lit("provenance"), "provenance", None, True, _per_lang(lambda lang: T.filled(BULLETIN[lang], no=F.col("bulletin_no"), at=T.local_time(F.col("issued_at"), lang, True))), prov, "imd_bulletin_no"),
        _fact(F.lit("provenance_short"), "provenance", None, False, _per_lang(lambda lang: T.filled(SHORT_BULLETIN[lang], no=F.col("bulletin_no"))), prov, "imd_bulletin_no"),
        _fact(F.lit("district"), "place", None, True, _per_lang(local), _HEAD, "district_name"),
        _fact(F.lit("landfall_window"), "text", None, False, _per_lang(lambda lang: quoted), prov, "landfall_window_text"),
        _fact(F.lit("ensemble_size"), "count", "members", False, _per_lang(lambda lang: T.filled(ENSEMBLE[lang], n=T.indian_group(members))), prov, "members", ens),
        _fact(F.lit("pop_cut_p50"), "count", "people", True, _per_lang(lambda lang: people("pop_p50", lang)), head, "pop_cut_hospital.p50", F.col("pop_p50").isNotNull()),
        _fact(F.lit("pop_cut_range"), "count", "people", True, both("pop_p10", "pop_p90", people), head, "pop_cut_hospital.p10_p90", ens & F.col("pop_p50").isNotNull() & F.col("pop_p10").isNotNull()),
        _fact(F.lit("fac_risk_p50"), "count", "facilities", False, _per_lang(lambda lang: count("fac_p50")), head, "facilities_at_risk.p50", F.col("fac_p50").isNotNull()),
        _fact(F.lit("fac_risk_range"), "count", "facilities", False, both("fac_p10", "fac_p90", plain), head, "facilities_at_risk.p10_p90", ens & F.col("fac_p50").isNotNull() & F.col("fac_p10").isNotNull()),
    ]
    out = _rows(scenarios, keys, 1, F.lit(0), of_scenario)

    mode = scenarios.select(*keys, "mode")
    top = facilities.filter("p is not null").withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p"), "facility_id"))).filter(F.col("_k") <= n_facilities).join(mode, keys)
    fid = lambda s: F.concat(F.lit("fac"), F.col("_k").cast("string"), F.lit(s))
    first = F.col("_k") == 1
    table = f"{_HEAD}.facilities"
    of_site = [
        _fact(fid("_name"), "place", None, first, _per_lang(lambda lang: T.facility_label(F.col("type"), F.col("name"), F.col("simulated"), lang)), table, F.col("facility_id")),
        _fact(fid("_p"), "probability", None, first, _per_lang(lambda lang: T.probability(F.col("p"))), table, F.col("facility_id"), ens),
        _fact(fid("_window"), "time_window", None, first, both("t10", "t90", lambda c, lang: T.local_time(F.col(c), lang)), table, F.col("facility_id"), F.col("t10").isNotNull() & F.col("t90").isNotNull()),
    ]
    out = out.union(_rows(top, keys, 2, F.col("_k"), of_site))

    acts = actions.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "action_id"))).filter(F.col("_k") <= n_actions).join(mode, keys)
    aid = lambda s: F.concat(F.lit("act"), F.col("_k").cast("string"), F.lit(s))
    table = f"{_HEAD}.actions"
    place = {"en-IN": F.col("place"), "te-IN": F.col("place_te"), "hi-IN": F.col("place_hi")}
    basis = lambda lang: F.coalesce(T.by_key(T.BASIS, F.col("basis"), lang), F.col("basis"))
    due = lambda lang: T.local_time(F.col("deadline"), lang)
    of_action = [
        _fact(aid("_site"), "place", None, first, _per_lang(lambda lang: T.site_label(F.col("crossing"), F.col("road"), F.col("place"), place[lang], lang)), table, F.col("action_id")),
        _fact(aid("_deadline"), "time", None, first, _per_lang(lambda lang: F.concat(due(lang), F.lit(" ("), basis(lang), F.lit(")"))), table, F.col("action_id")),
        _fact(aid("_deadline_short"), "time", None, False, _per_lang(due), table, F.col("action_id")),
        _fact(aid("_people"), "count", "people", False, _per_lang(lambda lang: T.people(F.col("people"), lang)), table, F.col("action_id")),
        _fact(aid("_p"), "probability", None, False, _per_lang(lambda lang: T.probability(F.col("p_event"))), table, F.col("action_id"), ens & F.col("p_event").isNotNull()),
    ]
    return out.union(_rows(acts, keys, 3, F.col("_k"), of_action))
