"""Text column functions: normalising, dates, bulletin tables, formatting, number safety, placeholders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories of systems, most severe first, with the words that name them and their least wind in knots.
CATEGORIES = [("SuCS", "super cyclonic storm"), ("ESCS", "extremely severe cyclonic storm"), ("VSCS", "very severe cyclonic storm"), ("SCS", "severe cyclonic storm"), ("CS", "cyclonic storm"), ("DD", "deep depression"), ("D", "depression")]
#: English number words, as patterns. "one" is none of them: "no one" and "one of the" are no quantities.
NUMBER_WORDS = ["zero", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundreds?", "thousands?", "lakhs?", "crores?", "millions?", "billions?", "percent", r"per\s+cent", "dozens?", "half"]
#: Months as they are written in bulletins.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
PLACEHOLDER = r"\{\{\s*([a-z0-9_]+)\s*\}\}"


def letters_only(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " "))


def letters_digits(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9.]+", " "))


def slug(*parts: Column) -> Column:
    return F.regexp_replace(F.lower(F.concat_ws("_", *parts)), "[^a-z0-9_]+", "_")


def parse_days(text: Column, year: int, month: int) -> Column:
    """Days named by a phrase such as "26th to 29th October" or "28 & 29": an array of dates, in the text's order.

    The month is the first of the year's that is named, else the given one. A phrase with "to", a hyphen or a dash is the
    range of its first two days. Numbers that are no day of the month are left out.
    """
    low = F.lower(text)
    days = F.transform(F.regexp_extract_all(low, F.lit(r"(\d{1,2})(?:st|nd|rd|th)?"), F.lit(1)), lambda d: d.cast("int"))
    named = F.lit(month)
    for k, name in reversed(list(enumerate(MONTHS, 1))):
        named = F.when(F.contains(low, F.lit(name.lower())), k).otherwise(named)
    first, second = F.get(days, F.lit(0)), F.get(days, F.lit(1))
    none = F.array().cast("array<int>")
    ranged = low.rlike(r"\bto\b|-|–") & (F.size(days) >= 2)
    listed = F.when(ranged, F.when(first <= second, F.sequence(first, F.greatest(first, second))).otherwise(none)).otherwise(days)
    last = F.dayofmonth(F.last_day(F.make_date(F.lit(year), named, F.lit(1))))
    return F.transform(F.filter(F.when(F.size(days) > 0, listed).otherwise(none), lambda d: (d >= 1) & (d <= last)), lambda d: F.make_date(F.lit(year), named, d))


def category_code(text: Column) -> Column:
    """Code of the first category, most severe first, whose words stand in the text."""
    out = F.lit(None).cast("string")
    for code, words in reversed(CATEGORIES):
        out = F.when(F.contains(F.lower(text), F.lit(words)), code).otherwise(out)
    return out


def bulletin_rows(texts: DataFrame) -> DataFrame:
    """Forecast rows in a bulletin's text: (text_id, seq, valid_utc, lat, lon, wind_lo, wind_hi, gust, category).

    A row reads like "27.10.25/1130 14.5/83.2 70-80 gusting to 90 Cyclonic Storm"; times are Indian Standard Time.
    """
    row = r"(\d{2}\.\d{2}\.\d{2})/(\d{4})\s+(\d{1,2}\.\d)/(\d{2,3}\.\d)\s+(\d{1,3})-(\d{1,3})\s+gusting to\s+(\d{1,3})\s+([A-Za-z ]+)"
    parts = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(row), F.lit(k)).alias(f"g{k}") for k in range(1, 9)])
    out = texts.select("text_id", F.posexplode(parts).alias("seq", "r"))
    ist = F.try_to_timestamp(F.concat_ws(" ", "r.g1", "r.g2"), F.lit("dd.MM.yy HHmm"))
    return out.select("text_id", "seq", (ist - F.expr("interval 330 minutes")).alias("valid_utc"), F.col("r.g3").try_cast("double").alias("lat"), F.col("r.g4").try_cast("double").alias("lon"), F.col("r.g5").try_cast("int").alias("wind_lo"), F.col("r.g6").try_cast("int").alias("wind_hi"), F.col("r.g7").try_cast("int").alias("gust"), category_code(F.col("r.g8")).alias("category"))


def max_voltage_kv(text: Column) -> Column:
    """Largest of several volt figures, in kV; null if none is a number."""
    parts = F.transform(F.split(text, "[;,/]"), lambda x: F.trim(x).try_cast("double"))
    return F.array_max(F.filter(parts, lambda x: x.isNotNull())) / 1000


def indian_group(n: Column) -> Column:
    """Digits grouped as 3,34,619."""
    s = F.abs(n).cast("string")
    head = F.regexp_replace(F.substring(F.concat(s), 1, 18), r"\d{3}$", "")
    tail = F.substring(s, -3, 3)
    grouped = F.concat(F.regexp_replace(head, r"(?<=\d)(?=(\d{2})+$)", ","), F.lit(","), tail)
    return F.concat(F.when(n < 0, "-").otherwise(""), F.when(F.length(s) > 3, grouped).otherwise(s))


def people(n: Column, lang: str = "en-IN") -> Column:
    """Rounded for readers: lakh from 100,000 on, hundreds from 1,000 on, tens from 10 on (halves to even), 0 at least.

    Lakh are rounded as the double that they are: 115,000 is a little under 1.15 lakh, and so 1.1.
    """
    n = F.greatest(n.cast("double"), F.lit(0.0))
    lakh = F.concat(F.replace(F.format_number(n / 100000, 1), F.lit(","), F.lit("")), F.lit(" " + LAKH[lang]))
    return F.when(n >= 100000, lakh).when(n >= 1000, indian_group((F.bround(n / 100) * 100).cast("long"))).when(n >= 10, indian_group((F.bround(n / 10) * 10).cast("long"))).otherwise(F.bround(n).cast("long").cast("string"))


def probability(p: Column) -> Column:
    """A share as a whole percentage, "<1%" under half a percent and ">99%" over 99 and a half."""
    pct = F.bround(p * 100).cast("long")
    return F.when(p < 0.005, "<1%").when(p > 0.995, ">99%").otherwise(F.concat(pct.cast("string"), F.lit("%")))


def local_time(ts: Column, lang: str = "en-IN", with_year: bool = False) -> Column:
    """A time such as "28 Oct, 22:30 IST", with the language's month and, if asked for, the year after it."""
    at = F.from_utc_timestamp(ts, "Asia/Kolkata")
    month = F.element_at(F.array(*[F.lit(m) for m in SHORT_MONTHS[lang]]), F.month(at))
    day = F.concat_ws(" ", F.dayofmonth(at).cast("string"), month, *([F.year(at).cast("string")] if with_year else []))
    return F.concat(day, F.lit(", "), F.date_format(at, "HH:mm"), F.lit(" IST"))


def range_text(a: Column, b: Column, lang: str = "en-IN") -> Column:
    """Two values as a range in the language's words."""
    return filled(RANGE[lang], a=a, b=b)


def filled(pattern: str, **values: Column) -> Column:
    """A pattern with its {names} replaced by columns."""
    parts = re.split(r"\{(\w+)\}", pattern)
    return F.concat(*[values[x].cast("string") if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def clean_name(name: Column) -> Column:
    """Mapped names such as "PHC,Rachapalli" as "PHC Rachapalli"; a space after other commas."""
    lead = F.regexp_replace(F.trim(name), r"^(U?PHC|CHC|SC)\s*,\s*", "$1 ")
    return F.regexp_replace(lead, r",(?=\S)", ", ")


def by_key(table: dict[str, dict[str, str]], key: Column, lang: str) -> Column:
    """The entry of a fixed table for a key, null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() if lang in v for x in (k, v[lang])]), F.coalesce(key, F.lit("")))


def site_label(crossing: Column, road: Column, place: Column, place_local: Column, lang: str = "en-IN") -> Column:
    """Where a crossing is: its kind, the place near it (by its name in the language, if there is one), and the road."""
    what = F.coalesce(by_key(CROSSING, crossing, lang), F.lit(CROSSING["road"][lang]))
    near = F.coalesce(F.nullif(place_local, F.lit("")), place) if lang != "en-IN" else place
    what = F.when(near.isNotNull(), filled(NEAR[lang], what=what, place=near)).otherwise(what)
    return F.when(F.coalesce(road, F.lit("")) != "", F.concat(what, filled(ON_ROAD[lang], road=road))).otherwise(what)


def facility_label(kind: Column, name: Column, simulated: Column, lang: str = "en-IN") -> Column:
    """A facility's clean name, or its kind where it has none; in other languages with the kind after it."""
    label = F.coalesce(by_key(FACILITY_TYPES, kind, lang), kind)
    own = F.when(F.coalesce(name, F.lit("")) != "", clean_name(name)).otherwise(label)
    mark = F.when(F.coalesce(simulated, F.lit(False)), " (SIMULATED)").otherwise("")
    return F.concat(own, mark) if lang == "en-IN" else F.concat(own, F.lit(" – "), label, mark)


def ist_time(ts: Column) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(ts, "Asia/Kolkata"), "HH:mm"), F.lit(" IST"))


def ist_date(ts: Column) -> Column:
    local = F.from_utc_timestamp(ts, "Asia/Kolkata")
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.concat_ws(" ", F.dayofmonth(local).cast("string"), F.element_at(names, F.month(local)))


def cap_time(ts: Column) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(ts, "Asia/Kolkata"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))


def number_problems(text: Column, allowed: Column, required: Column) -> Column:
    """What is unsafe in a draft outside its placeholders: digits, number words, percent signs, braces, ids."""
    used = F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)))
    # only letters that begin a number word are tried against the list
    words = r"(?i)\b(?=[zotfsenhlcmbpd])(?:" + "|".join(NUMBER_WORDS) + r")\b"
    unknown, missing = F.array_sort(F.array_except(used, allowed)), F.array_sort(F.array_except(required, used))
    in_text = lambda bare: F.array(
        F.when(bare.rlike(r"\p{Nd}"), "digit"),
        F.when(bare.rlike(words), "number word"),
        F.when(F.contains(bare, F.lit("%")), "percent sign"),
        F.when(F.contains(bare, F.lit("{{")) | F.contains(bare, F.lit("}}")), "malformed placeholder"),
    )
    of_ids = F.array(F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ","))), F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ","))))
    # the text without placeholders is made once, and only where there are any
    bare = F.when(F.contains(text, F.lit("{{")), F.regexp_replace(text, PLACEHOLDER, " ")).otherwise(text)
    return F.array_compact(F.concat(F.transform(F.array(bare), in_text)[0], of_ids))


def render(text: Column, facts: Column) -> Column:
    """{text, error}: placeholders replaced from a map; an error for an unknown key or a digit that no fact brought in."""
    pieces = F.split(text, PLACEHOLDER.replace("(", "(?:", 1))
    keys = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1))
    filled = F.transform(keys, lambda k: F.coalesce(F.try_element_at(facts, k), F.lit("")))
    woven = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(filled, i), F.lit("")))), "")
    unknown = F.filter(keys, lambda k: ~F.array_contains(F.map_keys(facts), k))
    error = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(F.array_distinct(unknown)), ","))).when(F.exists(pieces, lambda p: p.rlike(r"\p{Nd}")), F.lit("digit outside facts"))
    return F.struct(F.when(error.isNull(), woven).alias("text"), error.alias("error"))


def draft_problems(voice: Column, sms: Column) -> Column:
    return F.array_compact(F.array(F.when(F.size(F.filter(F.split(voice, r"\s+"), lambda w: w != "")) > 90, "voice too long"), F.when(F.length(sms) > 320, "message too long")))


def plain_code(code: Column) -> Column:
    return F.regexp_replace(F.coalesce(code.cast("string"), F.lit("")), r"^(\d+)\.0$", "$1")


def content_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


#: Names of health sites, the first that matches gives the tier.
TIER_PATTERNS = [
    ("district_hospital", r"(?i)\b(district\s+(head\s*quarters?\s+)?hospital|government\s+general\s+hospital|g\.?g\.?h\.?)\b"),
    ("sdh_area_hospital", r"(?i)\b(area\s+hospital|sub[\s-]*divisional\s+hospital|s\.?d\.?h\.?)\b"),
    ("chc", r"(?i)\b(community\s+health\s+cent(re|er)|c\.?h\.?c\.?)\b"),
    ("phc", r"(?i)\b(u?primary\s+health\s+cent(re|er)|u?p\.?h\.?c\.?|urban\s+primary\s+health)\b"),
    ("sub_centre", r"(?i)\b(sub[\s-]*cent(re|er)|health\s+and\s+wellness\s+cent(re|er)|h\.?w\.?c\.?|village\s+health\s+clinic|ysr\s+village\s+clinic)\b"),
]
#: Names of shelters, and kinds of shelter that are none against storms.
SHELTER_NAME = r"(?i)\b(cyclone\s+shelter|m\.?p\.?c\.?s\.?|multi[\s-]*purpose\s+cyclone)\b"
EXCLUDED_SHELTER_TYPES = ["public_transport", "picnic_shelter", "gazebo", "field_shelter", "lean_to", "sun_shelter"]
#: Tiers that count as a hospital, and the tiers that each tier refers to.
HOSPITAL_TYPES = ["district_hospital", "sdh_area_hospital", "chc", "phc"]
REFERRAL_TIERS = {"phc": ["chc", "sdh_area_hospital", "district_hospital"], "chc": ["sdh_area_hospital", "district_hospital"], "sdh_area_hospital": ["district_hospital"], "district_hospital": []}
#: Languages of facts, and their words.
LANGS = ["en-IN", "te-IN", "hi-IN"]
SHORT_MONTHS = {
    "en-IN": ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"],
    "te-IN": ["జనవరి", "ఫిబ్రవరి", "మార్చి", "ఏప్రిల్", "మే", "జూన్", "జూలై", "ఆగస్టు", "సెప్టెంబర్", "అక్టోబర్", "నవంబర్", "డిసెంబర్"],
    "hi-IN": ["जनवरी", "फ़रवरी", "मार्च", "अप्रैल", "मई", "जून", "जुलाई", "अगस्त", "सितंबर", "अक्टूबर", "नवंबर", "दिसंबर"],
}
LAKH = {"en-IN": "lakh", "te-IN": "లక్షలు", "hi-IN": "लाख"}
RANGE = {"en-IN": "{a} to {b}", "te-IN": "{a} నుండి {b} వరకు", "hi-IN": "{a} से {b} तक"}
DISTRICTS = {
    "Kakinada": {"te-IN": "కాకినాడ", "hi-IN": "काकीनाडा"},
    "Konaseema": {"te-IN": "కోనసీమ", "hi-IN": "कोनसीमा"},
    "East Godavari": {"te-IN": "తూర్పు గోదావరి", "hi-IN": "पूर्वी गोदावरी"},
    "West Godavari": {"te-IN": "పశ్చిమ గోదావరి", "hi-IN": "पश्चिमी गोदावरी"},
    "Eluru": {"te-IN": "ఏలూరు", "hi-IN": "एलुरु"},
    "Krishna district": {"te-IN": "కృష్ణా", "hi-IN": "कृष्णा"},
}
FACILITY_TYPES = {
    "district_hospital": {"en-IN": "District Hospital", "te-IN": "జిల్లా ఆసుపత్రి", "hi-IN": "ज़िला अस्पताल"},
    "sdh_area_hospital": {"en-IN": "Area Hospital", "te-IN": "ఏరియా ఆసుపత్రి", "hi-IN": "क्षेत्रीय अस्पताल"},
    "chc": {"en-IN": "CHC", "te-IN": "సామాజిక ఆరోగ్య కేంద్రం (CHC)", "hi-IN": "सामुदायिक स्वास्थ्य केंद्र (CHC)"},
    "phc": {"en-IN": "PHC", "te-IN": "ప్రాథమిక ఆరోగ్య కేంద్రం (PHC)", "hi-IN": "प्राथमिक स्वास्थ्य केंद्र (PHC)"},
    "shelter": {"en-IN": "cyclone shelter", "te-IN": "తుఫాను షెల్టర్", "hi-IN": "चक्रवात आश्रय"},
}
CROSSING = {
    "bridge": {"en-IN": "bridge", "te-IN": "వంతెన", "hi-IN": "पुल"},
    "culvert": {"en-IN": "culvert", "te-IN": "కల్వర్టు", "hi-IN": "पुलिया"},
    "ford": {"en-IN": "causeway", "te-IN": "కాజ్‌వే", "hi-IN": "रपटा"},
    "road": {"en-IN": "road", "te-IN": "రహదారి", "hi-IN": "सड़क"},
}
NEAR = {"en-IN": "{what} near {place}", "te-IN": "{place} సమీపంలోని {what}", "hi-IN": "{place} के पास {what}"}
ON_ROAD = {"en-IN": " on {road}", "te-IN": " ({road})", "hi-IN": " ({road})"}
BASIS = {
    "P10 closure - 6 h": {"en-IN": "P10 closure − 6 h", "te-IN": "P10 మూసివేత − 6 గంటలు", "hi-IN": "P10 बंद होना − 6 घंटे"},
    "IMD-track closure - 6 h": {"en-IN": "IMD-track closure − 6 h", "te-IN": "IMD ట్రాక్ మూసివేత − 6 గంటలు", "hi-IN": "IMD ट्रैक बंद होना − 6 घंटे"},
}


def health_tier(tags: Column) -> Column:
    """{tier, confidence} of a health site: by its names first, then by a hospital's tag; null if it is neither.

    A name counts for more where the site is tagged as a hospital, clinic or health centre as well.
    """
    tag = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    name = F.concat_ws(" ", *[F.nullif(tag(k), F.lit("")) for k in ("name", "name:en", "official_name")])
    tagged = tag("amenity").isin("hospital", "clinic") | tag("healthcare").isin("hospital", "clinic", "centre", "health_centre")
    out = F.lit(None).cast("struct<tier:string,confidence:string>")
    hospital = (tag("amenity") == "hospital") | (tag("healthcare") == "hospital")
    out = F.when(hospital, F.struct(F.lit("hospital_other").alias("tier"), F.lit("low").alias("confidence"))).otherwise(out)
    for tier, pattern in reversed(TIER_PATTERNS):
        found = F.struct(F.lit(tier).alias("tier"), F.when(tagged, "high").otherwise("medium").alias("confidence"))
        out = F.when(name.rlike(pattern), found).otherwise(out)
    return out


def is_shelter(tags: Column) -> Column:
    """Whether a site is a shelter: by name, as a place for emergencies, or as a shelter of a kind that is not excluded."""
    tag = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    kind = (tag("amenity") == "shelter") & ~tag("shelter_type").isin(*EXCLUDED_SHELTER_TYPES)
    return tag("name").rlike(SHELTER_NAME) | tag("emergency").isin("shelter", "assembly_point") | kind


def classify_pois(pois: DataFrame) -> DataFrame:
    """(poi_id, kind, type, name, confidence, voltage_kv) of sites (osm_type, osm_id, tags) that are of use.

    kind is substation or facility; a facility's type is its health tier or shelter, its name the tagged one or its type.
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    power = F.coalesce(tag("power"), F.lit("")) == "substation"
    p = pois.select(F.concat(F.lit("osm_"), F.substring("osm_type", 1, 1), F.col("osm_id").cast("string")).alias("poi_id"), "tags", health_tier(F.col("tags")).alias("h"), power.alias("power"), is_shelter(F.col("tags")).alias("shelter"))
    kind = F.when(F.col("h").isNotNull(), F.col("h.tier")).when(F.col("shelter"), "shelter")
    p = p.withColumn("type", F.when(~F.col("power"), kind)).filter("power or type is not null")
    return p.select(
        "poi_id",
        F.when(F.col("power"), "substation").otherwise("facility").alias("kind"),
        "type",
        F.when(F.col("power"), tag("name")).otherwise(F.coalesce(F.nullif(tag("name"), F.lit("")), F.regexp_replace("type", "_", " "))).alias("name"),
        F.when(~F.col("power"), F.when(F.col("h").isNotNull(), F.col("h.confidence")).otherwise("medium")).alias("confidence"),
        F.when(F.col("power"), max_voltage_kv(tag("voltage"))).alias("voltage_kv"),
    )


def referral_targets(df: DataFrame, tier: str = "tier") -> DataFrame:
    """A row per tier that each row's tier refers to: `target_tier`."""
    table = F.create_map(*[x for k, v in REFERRAL_TIERS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]).cast("array<string>"))])
    return df.withColumn("target_tier", F.explode(F.coalesce(F.try_element_at(table, F.col(tier)), F.array().cast("array<string>"))))


def reading_checks(readings: DataFrame, fixes: DataFrame) -> DataFrame:
    """(bulletin_id, check, status) for each rule, pass, fail or na.

    readings: bulletin_id, text, quotes ARRAY. fixes: bulletin_id, seq, lead_h, lat, lon, wind_kt, category.
    """
    from cutoffs.operators.series import fix_speeds

    low = F.create_map(*[x for k, v in (("D", 17), ("DD", 28), ("CS", 34), ("SCS", 48), ("VSCS", 64), ("ESCS", 90), ("SuCS", 120)) for x in (F.lit(k), F.lit(float(v)))])
    high = F.create_map(*[x for k, v in (("D", 27), ("DD", 33), ("CS", 47), ("SCS", 63), ("VSCS", 89), ("ESCS", 119), ("SuCS", 400)) for x in (F.lit(k), F.lit(float(v)))])
    slack = 1 / 1.852
    fits = (F.col("wind_kt") >= F.try_element_at(low, F.col("category")) - slack) & (F.col("wind_kt") <= F.try_element_at(high, F.col("category")) + slack)
    per = fixes.groupBy("bulletin_id").agg(F.bool_and(F.col("lat").between(0, 30) & F.col("lon").between(40, 100)).alias("in_basin"), F.bool_and(fits).alias("wind_matches_category"))
    per = per.join(fix_speeds(fixes, ["bulletin_id"]).select("bulletin_id", (F.coalesce("max_kmh", F.lit(0.0)) <= 60).alias("speed_plausible"), F.col("monotone").alias("leads_rise")), "bulletin_id")
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    quoted = F.forall("quotes", lambda q: F.contains(squeeze(F.col("text")), squeeze(q)))
    all_ = readings.select("bulletin_id", F.when(F.size("quotes") > 0, quoted).alias("quotes_verbatim"), (F.size("quotes") > 0).alias("has_quotes")).join(per, "bulletin_id", "left")
    names = ["in_basin", "leads_rise", "speed_plausible", "wind_matches_category", "has_quotes", "quotes_verbatim"]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.when(F.col(n).isNull(), "na").when(F.col(n), "pass").otherwise("fail").alias("status")) for n in names]))
    return all_.select("bulletin_id", rows.alias("r")).select("bulletin_id", "r.check", "r.status")


def alert_problems(restricted: Column, restriction: Column, sent: Column, polygon: Column, lat: Column) -> Column:
    """Rules for an alert row: restriction given if restricted, time with offset, closed polygon, latitude in range."""
    pts = F.filter(F.split(polygon, " "), lambda p: p != "")
    return F.array_compact(
        F.array(
            F.when(restricted & (F.coalesce(restriction, F.lit("")) == ""), "restriction missing"),
            F.when(~F.coalesce(sent.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d\d:\d\d$"), F.lit(False)), "bad time"),
            F.when((F.size(pts) < 4) | (F.get(pts, F.lit(0)) != F.element_at(pts, -1)), "polygon not closed"),
            F.when((lat < -90) | (lat > 90), "latitude out of range"),
        )
    )


def route_reports(reports: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds decision (auto_apply or queue) and reasons to field reports.

    reports: asset_id, kind, location_ok, passability, confidence, previous. candidates: asset_id. A bridge that was closed
    and is reported open always waits for a person.
    """
    known = candidates.select("asset_id").distinct().withColumn("_known", F.lit(True))
    out = reports.join(known, "asset_id", "left")
    reopening = (F.col("kind") == "bridge") & (F.coalesce("previous", F.lit("")) == "closed") & (F.col("passability") == "open")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_known").isNull(), "asset not matched"),
            F.when(~F.coalesce("location_ok", F.lit(False)), "location not consistent"),
            F.when(F.coalesce("passability", F.lit("unknown")) == "unknown", "passability unknown"),
            F.when(F.coalesce("confidence", F.lit(0.0)) < 0.8, "low confidence"),
            F.when(reopening, "bridge reopening"),
        )
    )
    return out.withColumn("reasons", reasons).drop("_known").withColumn("decision", F.when(F.size("reasons") == 0, "auto_apply").otherwise("queue"))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def listing_rows(pages: DataFrame) -> DataFrame:
    """(page_id, seq, href, title): links of an archive page, tags stripped, spaces collapsed, addresses completed."""
    link = r'(?s)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(link), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(link), F.lit(2)).alias("title"))
    out = pages.select("page_id", "url", F.posexplode(both).alias("seq", "l"))
    title = F.trim(F.regexp_replace(F.regexp_replace("l.title", "<[^>]*>", " "), r"\s+", " "))
    site = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    href = F.when(F.col("l.href").rlike("^https?://"), F.col("l.href")).when(F.startswith(F.col("l.href"), F.lit("/")), F.concat(site, F.col("l.href"))).otherwise(F.concat(site, F.lit("/"), F.col("l.href")))
    return out.select("page_id", "seq", href.alias("href"), title.alias("title"))


def newest_bulletin(texts: DataFrame, now: Column, most_h: float = 36.0) -> DataFrame:
    """(based_on, number, age_h, active) of the newest text with "based on HH:MM UTC of DD-MM-YYYY"."""
    pattern = r"(?i)based on (\d{2})(?::?)(\d{2}) UTC of (\d{2})-(\d{2})-(\d{4})"
    part = lambda k: F.regexp_extract("text", pattern, k)
    at = F.try_to_timestamp(F.concat(part(5), part(4), part(3), part(1), part(2)), F.lit("yyyyMMddHHmm"))
    t = texts.withColumn("based_on", at).withColumn("number", F.nullif(F.regexp_extract("url", r"(\d+)\.pdf", 1), F.lit("")).try_cast("int"))
    best = t.filter("based_on is not null").agg(F.max(F.struct("based_on", "number")).alias("m")).select("m.*")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros("based_on")) / 3.6e9
    return best.withColumn("age_h", age).withColumn("active", F.coalesce(F.col("age_h") <= most_h, F.lit(False)))


def probability_by(deciles: Column, hour: Column, never: float = 999.0) -> Column:
    """P(event by the hour) from an array of nine deciles: the largest tenth whose hour is not later; null and never don't count."""
    return F.size(F.filter(deciles, lambda x: x.isNotNull() & (x <= hour) & (x < never))) / 10


def hours_to_iso(hours: Column, origin: Column) -> Column:
    """The UTC time so many hours after origin (a timestamp), null for infinite or missing hours."""
    finite = F.abs(hours) < 1e9
    at = F.unix_seconds(origin.cast("timestamp")) + F.when(finite, hours) * 3600
    return F.when(finite, F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def label_agreement(pairs: DataFrame, ok: str = "ok", id_col: str = "id", shown: int = 12) -> DataFrame:
    """One row: agree, total, and the ids of the first `shown` rows that differ."""
    first = pairs.filter(~F.col(ok)).orderBy(id_col).limit(shown).agg(F.array_sort(F.collect_list(id_col)).alias("differing"))
    return pairs.agg(F.count(F.when(F.col(ok), 1)).alias("agree"), F.count("*").alias("total")).join(F.broadcast(first))


def citations(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """(text_id, fact_id, value): the facts (fact_id, value) that a text (text_id, text) names in its placeholders, once each."""
    ids = texts.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(1)))).alias("fact_id"))
    return ids.join(facts.select("fact_id", "value"), "fact_id").select("text_id", "fact_id", "value")


def known_bulletins(configs: DataFrame) -> DataFrame:
    """(storm, run_id, bulletin_no, url, sha256) of each run in storm configurations that names a bulletin's address and hash.

    configs: storm, runs ARRAY of {run_id, bulletin_no, url, sha256}; empty texts count as missing.
    """
    r = configs.select("storm", F.explode("runs").alias("r")).select("storm", "r.*")
    return r.filter("url <> '' and sha256 <> ''").select("storm", "run_id", "bulletin_no", "url", "sha256")


def verified(files: DataFrame, registry: DataFrame) -> DataFrame:
    """files (file_id, content) with status against a registry (file_id, sha256): ok, changed or unknown."""
    both = files.join(registry.select("file_id", F.col("sha256").alias("_want")), "file_id", "left")
    status = F.when(F.col("_want").isNull(), "unknown").when(F.sha2("content", 256) == F.col("_want"), "ok").otherwise("changed")
    return both.withColumn("status", status).drop("_want")


def find_by_name(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name_id, name): the first name (name_id, name, variants ARRAY) that a query (query_id, q) is or is part of.

    Both are compared in lower case without "district". A query's first characters, three at most, are joined with the
    pieces of as many characters of the names, so that no query is held against all names.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.trim(F.lower(c)), " district", ""))
    all_ = F.concat(F.array("name"), F.coalesce("variants", F.array().cast("array<string>")))
    n = names.select("name_id", "name", F.explode(all_).alias("v")).select("name_id", "name", norm(F.col("v")).alias("v")).filter("v <> ''").distinct()
    at = F.sequence(F.lit(1), F.length("v"))
    pieces = lambda k: F.transform(at, lambda i: F.substring(F.col("v"), i, F.lit(k)))
    grams = F.flatten(F.array(pieces(1), pieces(2), pieces(3)))
    index = n.withColumn("gram", F.explode(F.array_distinct(grams)))
    q = queries.select("query_id", norm(F.col("q")).alias("q")).filter("q <> ''").withColumn("gram", F.substring("q", 1, 3))
    met = q.join(index, "gram").filter(F.contains("v", "q"))
    return met.groupBy("query_id").agg(F.min(F.struct("name_id", "name")).alias("m")).select("query_id", "m.name_id", "m.name")


def alert_rows(alerts: DataFrame, prefix: str = "ALERT") -> DataFrame:
    """(identifier, sent, expires, polygon, run_id, district, language, headline): a row per alert and language.

    alerts: run_id, district, sent, landfall, infos ARRAY of {language, headline}, ring ARRAY of {lon, lat}. The identifier
    is made of run, district and a hash of both, the time and all headlines; times carry the local offset; an alert ends a
    day after landfall (null without one). The ring is closed and written as "lat,lon" pairs of four decimals at most; a
    ring of fewer than four points, or none, gives null.
    """
    sent = cap_time(F.col("sent"))
    heads = F.array_join(F.transform("infos", lambda i: F.concat(i["language"], i["headline"])), "|")
    key = F.concat_ws("|", F.col("run_id").cast("string"), F.col("district").cast("string"), sent, heads)
    place = lambda p: F.struct(F.round(p["lat"], 4).alias("lat"), F.round(p["lon"], 4).alias("lon"))
    rows = alerts.withColumn("_ring", F.transform("ring", place))
    rows = rows.withColumn("_ring", F.when(F.get("_ring", F.lit(0)) == F.element_at("_ring", -1), F.col("_ring")).otherwise(F.concat("_ring", F.slice("_ring", 1, 1))))
    line = F.array_join(F.transform("_ring", lambda p: F.concat_ws(",", p["lat"].cast("string"), p["lon"].cast("string"))), " ")
    one = rows.select(
        F.concat(F.lit(prefix + "-"), F.concat_ws("-", F.col("run_id").cast("string"), F.col("district").cast("string"), F.substring(F.sha2(key, 256), 1, 10))).alias("identifier"),
        sent.alias("sent"),
        cap_time(F.col("landfall") + F.expr("interval 24 hours")).alias("expires"),
        F.when(F.size("_ring") >= 4, line).alias("polygon"),
        "run_id",
        "district",
        F.explode("infos").alias("i"),
    )
    return one.select("identifier", "sent", "expires", "polygon", "run_id", "district", "i.language", "i.headline")
