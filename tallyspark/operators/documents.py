"""Document texts: languages, fingerprints, numbers in words, term distances, positioned words, equations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import bound
from tallyspark.functions.names import simplify

#: Frequent words by language, fixed values.
FREQUENT = {"en": ["the", "and", "of", "to", "in"], "fr": ["le", "la", "les", "des", "et"], "de": ["der", "die", "das", "und", "nicht"], "es": ["el", "los", "las", "que", "y"], "tr": ["ve", "bir", "bu", "ile", "icin"]}


def guess_language(texts: DataFrame) -> DataFrame:
    """The language with most frequent words in `text`; ties by the order of FREQUENT, none if no word is known."""
    known = lambda ws: lambda w: w.isin(ws)
    scores = lambda words: F.array(*[F.struct(F.size(F.filter(words, known(ws))).alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("language")) for i, (k, ws) in enumerate(FREQUENT.items())])
    best = bound(F.split(simplify("text"), " "), lambda words: F.array_max(scores(words)))
    said = bound(best, lambda b: F.struct(F.when(b["score"] > 0, b["language"]).otherwise("").alias("language"), b["score"].alias("score")))
    return texts.select("doc_id", said.alias("said")).select("doc_id", "said.language", "said.score")


def fingerprint(text: str | Column) -> Column:
    """MD5 of the letters-only skeleton of the first sixty lines."""
    lines = F.slice(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n"), 1, 60)
    return F.md5(F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(F.lower(x), "[^a-z]+", "")), lambda x: x != ""), "|"))


def wilson(hits: str, trials: str, z: float = 1.96) -> Column:
    """Lower bound of the share of hits; 0 without trials."""
    n, p = F.col(trials).cast("double"), F.col(hits) / F.col(trials)
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(n > 0, low).otherwise(0.0)


def equations(values: DataFrame, rules: DataFrame) -> DataFrame:
    """`values` (doc_id, field, amount_kr) against `rules` (equation, field, sign; sign 0 for the target): whether the signed sum is the target.

    The tolerance is a kurus for each term and one more, two at least; a missing field leaves the equation open.
    """
    met = values.join(F.broadcast(rules), "field")
    need = rules.groupBy("equation").agg(F.count("*").alias("fields"), F.count_if(F.col("sign") != 0).alias("terms"))
    sums = met.groupBy("doc_id", "equation").agg(F.count("*").alias("got"), F.sum(F.col("sign") * F.col("amount_kr")).alias("sum_kr"), F.max(F.when(F.col("sign") == 0, F.col("amount_kr"))).alias("target_kr"))
    out = sums.join(F.broadcast(need), "equation")
    holds = F.abs(F.col("sum_kr") - F.col("target_kr")) <= F.greatest(F.col("terms") + 1, F.lit(2))
    return out.select("doc_id", "equation", "sum_kr", "target_kr", F.when(F.col("got") < F.col("fields"), "open").when(holds, "holds").otherwise("fails").alias("status"))


#: Number words without accents, fixed values: from 0 up, the tens from 20 (Turkish: all in one row with those), other forms,
#: hundreds, scales, and words that stand among them and say nothing.
NUMBER_WORDS = {
    "tr": {
        "ones": "sifir bir iki uc dort bes alti yedi sekiz dokuz on", "tens": "yirmi otuz kirk elli altmis yetmis seksen doksan", "also": {}, "hundreds": {"yuz": 100},
        "scales": {"bin": 10**3, "milyon": 10**6, "milyar": 10**9}, "noise": "yalniz yaziyla tl turk lirasi lira kurus ve",
    },
    "en": {
        "ones": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen", "tens": "twenty thirty forty fifty sixty seventy eighty ninety", "also": {}, "hundreds": {"hundred": 100},
        "scales": {"thousand": 10**3, "million": 10**6, "billion": 10**9}, "noise": "and only say dollars dollar cents cent pounds euros",
    },
    "de": {
        "ones": "null eins zwei drei vier funf sechs sieben acht neun zehn elf zwolf dreizehn vierzehn funfzehn sechzehn siebzehn achtzehn neunzehn", "tens": "zwanzig dreissig vierzig funfzig sechzig siebzig achtzig neunzig", "also": {"ein": 1}, "hundreds": {"hundert": 100},
        "scales": {"tausend": 10**3, "million": 10**6, "millionen": 10**6, "milliarde": 10**9, "milliarden": 10**9}, "noise": "und euro cent in worten",
    },
    "fr": {
        "ones": "zero un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize", "tens": "vingt trente quarante cinquante soixante", "also": {"une": 1, "vingts": 20}, "hundreds": {"cent": 100, "cents": 100},
        "scales": {"mille": 10**3, "million": 10**6, "millions": 10**6, "milliard": 10**9, "milliards": 10**9}, "noise": "et euros euro centimes centime la somme de",
    },
    "ru": {
        "ones": "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать", "tens": "двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто",
        "also": {"одна": 1, "одно": 1, "две": 2}, "hundreds": {"сто": 100, "двести": 200, "триста": 300, "четыреста": 400, "пятьсот": 500, "шестьсот": 600, "семьсот": 700, "восемьсот": 800, "девятьсот": 900},
        "scales": {"тысяча": 10**3, "тысячи": 10**3, "тысяч": 10**3, "миллион": 10**6, "миллиона": 10**6, "миллионов": 10**6, "миллиард": 10**9, "миллиарда": 10**9, "миллиардов": 10**9}, "noise": "и рублей рубль рубля копеек копейки прописью",
    },
}


def number_words(language: str) -> dict[str, tuple[int, int]]:
    """Each word's value and kind: 0 adds, 1 is a hundred, 2 a scale, 3 says nothing."""
    w = NUMBER_WORDS[language]
    found = {x: (0, 3) for x in w["noise"].split()}
    found |= {x: (i, 0) for i, x in enumerate(w["ones"].split())} | {x: (20 + 10 * i, 0) for i, x in enumerate(w["tens"].split())} | {x: (v, 0) for x, v in w["also"].items()}
    return found | {x: (v, 1) for x, v in w["hundreds"].items()} | {x: (v, 2) for x, v in w["scales"].items()}


def words_to_number(text: str | Column, language: str = "tr") -> Column:
    """The whole number that `text` says; null where a word does not begin with a number word or one that says nothing.

    A word is read from its beginning as the longest words that it is made of (`siebenundsiebzig`); an ending that is none is
    an inflection.  Values add up; a hundred multiplies what stands before it, a scale closes the block; French
    `quatre vingt` is 80.  Digits are skipped.
    """
    known = number_words(language)
    pattern = r"\G(" + "|".join(sorted(known, key=lambda x: (-len(x), x))) + ")"
    x = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(F.translate(F.lower(x), "ё", "е"), r"[^\p{L}\p{N}]+", " ") if language == "ru" else simplify(F.translate(x, "İ", "i"))
    words = F.filter(F.split(plain, " "), lambda w: F.translate(w, "0123456789", "") != "")
    read = F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(pattern), 1))  # of each word what it is made of: nothing if it begins with none
    table = F.create_map(*[v for k, (n, kind) in known.items() for v in (F.lit(k), F.struct(F.lit(n).cast("bigint").alias("value"), F.lit(kind).alias("kind")))])
    valued = lambda parts: F.filter(F.transform(F.flatten(parts), lambda k: F.element_at(table, k)), lambda v: v["kind"] < 3)
    zero = F.lit(0).cast("bigint")

    def step(a, v):
        n, block = v["value"], a["block"]
        eighty = (F.lit(language) == "fr") & (n == 20) & (a["last"] == 4)
        hundred = F.when(n >= 200, block + n).when(block == 0, n).otherwise(block * 100)
        now = F.when(v["kind"] == 1, hundred).when(v["kind"] == 2, zero).when(eighty, block + 76).otherwise(block + n)
        total = F.when(v["kind"] == 2, a["total"] + F.greatest(block, F.lit(1).cast("bigint")) * n).otherwise(a["total"])
        return F.struct(total.alias("total"), now.alias("block"), n.alias("last"))

    start = F.struct(zero.alias("total"), zero.alias("block"), zero.alias("last"))
    said = lambda values: F.when(F.size(values) > 0, F.aggregate(values, start, step, lambda a: a["total"] + a["block"]))
    return bound(read, lambda parts: F.when(F.forall(parts, lambda p: F.size(p) > 0), bound(valued(parts), said)))


def spelled(df: DataFrame, language: str = "tr") -> DataFrame:
    """`df` (text) with `number`."""
    return df.withColumn("number", words_to_number("text", language))


#: Letters that scans confuse; a swap costs 0.4.
CONFUSED = [set("il1j"), set("o0"), set("rn"), set("ce"), set("uv"), set("s5"), set("b8"), set("g9q")]


def distance(a: str, b: str) -> float:
    """Edit distance with transpositions and cheap swaps of confusable letters."""
    cost = lambda x, y: 0.0 if x == y else 0.4 if any(x in s and y in s for s in CONFUSED) else 1.0
    d = [[float(i + j if i * j == 0 else 0) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + cost(a[i - 1], b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def corrected(terms: DataFrame, lexicon: list[str], share: float = 0.34, margin: float = 0.3) -> DataFrame:
    """`terms` (id, term) with the nearest lexicon term: TAM equal, ONERI near and alone, BELIRSIZ near but not alone, BILINMIYOR.

    The lexicon is a parameter of bounded size.
    """

    def near(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s.fillna(""):
            best = sorted((distance(t, w), w) for w in lexicon if abs(len(w) - len(t)) <= share * max(len(t), 1) + 1)[:2]
            if t in lexicon:
                rows.append((t, 0.0, "TAM"))
            elif not best or best[0][0] > share * len(t):
                rows.append((None, None, "BILINMIYOR"))
            else:
                alone = len(best) < 2 or best[1][0] - best[0][0] >= margin
                rows.append((best[0][1], best[0][0], "ONERI" if alone else "BELIRSIZ"))
        return pd.DataFrame(rows, columns=["match", "distance", "status"])

    udf = F.pandas_udf(near, "match string, distance double, status string")
    return terms.withColumn("r", udf("term")).select("id", "term", "r.match", F.round("r.distance", 6).alias("distance"), "r.status")


def positioned(pages: DataFrame) -> DataFrame:
    """`pages` (doc_id, page, xhtml) with `<word xMin.. yMin.. xMax.. yMax..>text</word>` to one row for each word."""
    number = lambda name: F.regexp_extract("w", name + r'="([0-9.]+)"', 1).cast("double")
    each = pages.select("doc_id", "page", F.posexplode(F.regexp_extract_all("xhtml", F.lit(r"(<word [^>]*>[^<]*</word>)"), 1)).alias("k", "w"))
    text = F.regexp_extract("w", ">([^<]*)<", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return each.select("doc_id", "page", "k", text.alias("text"), *[number(n).alias(a) for n, a in (("xMin", "x0"), ("yMin", "y0"), ("xMax", "x1"), ("yMax", "y1"))])


def line_items(lines: DataFrame) -> DataFrame:
    """`lines` (doc_id, line, text): the triple of numbers with quantity * price = amount to a kurus that has the largest amount."""
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"(\d+(?:\.\d{1,2})?)"), 1), lambda x: x.cast("double"))
    df = lines.withColumn("v", numbers).where("size(v) >= 3")
    triples = F.flatten(F.flatten(F.transform("v", lambda q, i: F.transform("v", lambda p, j: F.transform(F.filter("v", lambda a, k: (i < j) & (j < k) & (F.abs(q * p - a) <= 0.011)), lambda a: F.struct(a.alias("amount"), q.alias("qty"), p.alias("price")))))))
    name = F.trim(F.regexp_extract("text", r"^([^\d]*)", 1))
    return df.select("doc_id", "line", name.alias("name"), F.array_max(triples).alias("t")).where("t is not null and length(name) >= 2").select("doc_id", "line", "name", "t.qty", "t.price", "t.amount")


#: Points of a document's confidence, and what findings take from it, fixed values.
POINTS = {"language": 10, "kind": 10, "total": 15, "date": 10, "party": 10, "words": 25, "items": 20, "sum": 15}
SEVERITY = {"B00": 0, "B01": 40, "B02": 10, "B03": 40, "B04": 10, "B05": 10, "B06": 10, "B07": 40, "B08": 10, "B09": 0, "B10": 10, "B11": 10}
#: Languages whose tax fields are read as well.
CORE = ["tr", "en"]
READY = 60


def resolve(read: DataFrame) -> DataFrame:
    """What speaks for and against each document as it was read: findings in order, confidence from 0 to 100, ready for the books or not.

    `read`: doc_id, language, kind, date, party, net_kr, vat_kr, rate, total_kr, words_kr (the amount in words), items_kr (their
    sum), n_items, n_read (items that are numbers), needs_party; null or empty where nothing was read.  It may have label_states,
    an array of what `terms.corrected` says of each label (ONERI: one suggestion; BELIRSIZ: several).
    B00 digits and words, or items and total, confirm each other; B01 no language; B02 no kind; B03 digits against words; B04
    items against net (or total, if net or tax is missing); B05 net and tax against total; B06 tax against its rate by more than
    100 kurus; B07 a field is missing that must be there; B08 items that are no numbers; B09 tax fields of the language are not
    read; B10 a label has a suggestion, B11 several, each label for itself.  B01, B03 and B07 keep a document from the books.
    """
    c = F.col
    empty = lambda x: F.coalesce(c(x), F.lit("")) == ""
    spoken = c("total_kr").isNotNull() & c("words_kr").isNotNull()
    spoken_right = spoken & ((c("words_kr") == c("total_kr")) | (c("words_kr") == c("total_kr") - c("total_kr") % 100))
    whole = c("net_kr").isNotNull() & c("vat_kr").isNotNull()
    itemised = (c("n_read") > 0) & c("total_kr").isNotNull()
    itemised_right = itemised & (c("items_kr") == F.when(whole, c("net_kr")).otherwise(c("total_kr")))
    three = whole & c("total_kr").isNotNull()
    expected = F.call_function("div", c("net_kr") * c("rate"), F.lit(100))
    found = [
        ("B01", empty("language")), ("B09", ~empty("language") & ~c("language").isin(CORE)), ("B02", empty("kind")), ("B08", c("n_read") < c("n_items")), ("B00", spoken_right), ("B03", spoken & ~spoken_right), ("B00", itemised_right), ("B04", itemised & ~itemised_right),
        ("B05", three & (c("net_kr") + c("vat_kr") != c("total_kr"))), ("B06", three & (c("rate") > 0) & (c("net_kr") > 0) & (F.abs(expected - c("vat_kr")) > 100)),
        ("B07", c("date").isNull() | c("total_kr").isNull() | (c("needs_party") & empty("party") & ~empty("kind"))),
    ]
    points = {
        "language": ~empty("language"), "kind": ~empty("kind"), "total": c("total_kr").isNotNull(), "date": c("date").isNotNull(), "party": ~empty("party"), "words": spoken_right, "items": itemised_right,
        "sum": three & (c("net_kr") + c("vat_kr") == c("total_kr")),
    }
    yes = lambda x: F.coalesce(x, F.lit(False))
    score = sum((F.when(yes(x), POINTS[k]).otherwise(0) for k, x in points.items()), F.lit(0)) - sum((F.when(yes(x), SEVERITY[k]).otherwise(0) for k, x in found), F.lit(0))
    codes = F.array_compact(F.array(*[F.when(yes(x), F.lit(k)) for k, x in found]))
    if "label_states" in read.columns:
        unsure = F.filter(F.coalesce("label_states", F.array().cast("array<string>")), lambda x: x.isin("ONERI", "BELIRSIZ"))
        codes = F.concat(codes, F.transform(unsure, lambda x: F.when(x == "ONERI", "B10").otherwise("B11")))
        score = score - 10 * F.size(unsure)
    held = F.arrays_overlap(codes, F.array(*[F.lit(k) for k, v in SEVERITY.items() if v == 40]))
    confidence = F.greatest(F.least(score, F.lit(100)), F.lit(0))
    return read.select("doc_id", F.array_join(codes, ",").alias("findings"), confidence.cast("int").alias("confidence"), (~held & (confidence >= READY)).alias("ready"))
