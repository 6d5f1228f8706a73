"""Text functions, Column -> Column, all inside Spark's expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = (
    "а в во где год для и или как какая каком какого какие какой какое каков какую когда которого которой которое который которые кто "
    "на о об от по почему при произошел произошла произошли произошло с со сравни сравнение такое у чем что это the what when where who "
    "why дай информация информацию кратко локальном локальный опиши подробно расскажи сведения году выпуска каждого конкретные релиз "
    "релиза релизы сравните тип типу укажите формат формата значение значения альбом альбома"
).split()
MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
NO_ANSWER = (
    "недостаточно", "нет доказательств", "не найден", "не найдена", "не найдено", "отсутствует информация", "информация отсутствует",
    "отсутствуют сведения", "нет сведений", "нет информации", "не указано", "не содержит информации", "не удалось определить",
    "невозможно определить", "cannot answer", "cannot determine", "insufficient", "not specified", "no information",
    "does not contain information",
)
VALUES = r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b\d{3,4}\b|\b\d+(?:[,.]\d+)?\b"
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """White-space separated words; none for null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def normalize(text: Column) -> Column:
    """Case folded; everything but letters and digits is one space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def token_total(text: Column) -> Column:
    """How many tokens a text has, without making them; null for null."""
    return F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}]+"))


def distinct_tokens(text: Column, longer_than: int = 0) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda w: F.length(w) > longer_than))


def significant_terms(text: Column) -> Column:
    """Distinct tokens of three and more characters that are neither stop words nor numbers."""
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS) & ~w.rlike(r"^\p{N}+$")))


def token_count(text: Column) -> Column:
    """Runs of word characters, and every other sign by itself; at least one."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))).cast("long")


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def replacement_ratio(text: Column) -> Column:
    """Share of U+FFFD."""
    return F.regexp_count(text, F.lit("�")) / F.greatest(F.length(text), F.lit(1))


def answer_form(text: Column) -> Column:
    """Word characters in lower case, one space between runs."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def script_language(text: Column) -> Column:
    """struct(language, confidence): 'ru' where Cyrillic letters are no fewer than Latin ones, 'en' else, 'und' without either."""
    cyrillic = F.regexp_count(F.lower(text), F.lit("[а-яё]"))
    latin = F.regexp_count(F.lower(text), F.lit("[a-z]"))
    both, most = cyrillic + latin, F.greatest(cyrillic, latin)
    language = F.when(both == 0, "und").when(cyrillic >= latin, "ru").otherwise("en")
    sure = F.when(both == 0, 0.0).otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.5), most / both)))
    return F.struct(language.alias("language"), F.round(sure, 6).alias("confidence"))


def dates(text: Column) -> Column:
    """ISO, then dotted, then Russian month dates, as yyyy-MM-dd; invalid ones dropped, each once."""
    iso = F.regexp_extract_all(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))
    dotted = F.regexp_extract_all(text, F.lit(r"\b\d{1,2}\.\d{1,2}\.\d{4}\b"), F.lit(0))
    named = F.regexp_extract_all(F.lower(text), F.lit(rf"\b\d{{1,2}} (?:{'|'.join(MONTHS)}) \d{{4}}\b"), F.lit(0))
    month = F.array(*(F.lit(m) for m in MONTHS))

    def from_parts(parts: Column, number: Column) -> Column:
        return F.concat_ws("-", parts[2], F.lpad(number, 2, "0"), F.lpad(parts[0], 2, "0"))

    dotted = F.transform(dotted, lambda d: from_parts(F.split(d, r"\."), F.split(d, r"\.")[1]))
    named = F.transform(named, lambda d: from_parts(F.split(d, " "), F.array_position(month, F.split(d, " ")[1]).cast("string")))
    return F.array_distinct(F.filter(F.concat(iso, dotted, named), lambda d: F.try_to_date(d, "yyyy-MM-dd").isNotNull()))


def values(text: Column, most: int = 8) -> Column:
    """Dates, years and numbers in order of appearance, each once; the first few are what the gate compares."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(VALUES), F.lit(0))), 1, most)


def names(text: Column, most: int = 10) -> Column:
    """Words of three and more Latin or Cyrillic letters with a capital in front, no stop words; each once by its normal form, the first few."""
    found = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё-]{2,}"), F.lit(0)), lambda w: w.rlike(r"^\p{Lu}"))
    found = F.transform(F.transform(found, lambda w: F.btrim(w, F.lit("-"))), lambda w: F.struct(w.alias("name"), normalize(w).alias("form")))
    found = F.filter(found, lambda x: (x["form"] != "") & ~x["form"].isin(*STOPWORDS))
    known = lambda seen, x: (F.size(seen) >= most) | F.exists(seen, lambda y: y["form"] == x["form"])  # noqa: E731  one pass: a word meets the few names kept so far
    first = F.aggregate(found, F.slice(found, 1, 0), lambda seen, x: F.when(known(seen, x), seen).otherwise(F.concat(seen, F.array(x))))
    return F.transform(first, lambda x: x["name"])


def codes(text: Column) -> Column:
    """Codes such as AB-12, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,}-\d+\b"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def terms_overlap(a: Column, b: Column) -> Column:
    """A common term, or two of five and more characters that begin with the same five."""

    def heads(x):
        return F.transform(F.filter(x, lambda w: F.length(w) >= 5), lambda w: F.left(w, F.lit(5)))

    return F.arrays_overlap(a, b) | F.arrays_overlap(heads(a), heads(b))


def snippet(text: Column, query: Column, width: int = 360) -> Column:
    """The text if it is short, else a window around the query's first term of three and more characters that it has."""
    flat = F.trim(F.regexp_replace(text, SPACE, " "))
    found = F.filter(F.transform(F.filter(tokens(query), lambda w: F.length(w) >= 3), lambda w: F.instr(F.lower(flat), w)), lambda p: p > 0)
    start = F.greatest(F.lit(0), F.coalesce(F.get(found, F.lit(0)), F.lit(1)) - 1 - width // 2)
    start = F.least(start, F.length(flat) - width)
    cut = F.substring(flat, start + 1, F.lit(width))
    left, right = F.when(start > 0, "...").otherwise(""), F.when(start + width < F.length(flat), "...").otherwise("")
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(left, cut, right))


def no_answer(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(NO_ANSWER)), F.lit(False))


def stable_hash(*parts: Column, length: int = 24) -> Column:
    """First hex digits of SHA-1 over the parts, each closed by a unit separator; null reads None."""
    closed = [F.concat(F.coalesce(p.cast("string"), F.lit("None")), F.lit("\x1f")) for p in parts]
    return F.left(F.sha1(F.concat(*closed).cast("binary")), F.lit(length))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
