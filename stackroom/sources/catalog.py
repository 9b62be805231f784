"""Catalogue sources: sheets, MARC and MODS records, manifests, file listings. Parsers are Column -> Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.functions.text import strip_punctuation, year

# The article sheet's columns and what they are called here.
ARTICLE_COLUMNS = {
    "KCI_FI_ID": "cnts_id", "ARTI_ID": "record_id", "GRADE": "grade", "TITLE_KR": "title", "TITLE_EN": "title_remainder", "AUTHORS": "personal_author", "INSTITUTION": "corporate_author",
    "JOURNAL": "series_title", "VOL_ISSUE": "vol_issue", "PAGES": "extent", "YEAR_MONTH": "pub_date", "KCI_CITATIONS": "kci_citations", "WOS_CITATIONS": "wos_citations",
}
# Field -> (tag, subfield) in order of preference.
MARC_FIELDS = {
    "record_id": [("001", "")], "last_modified": [("005", "")], "isbn": [("020", "a")], "holdings": [("049", "a")], "kdc": [("056", "a")], "ddc": [("082", "a")],
    "title": [("245", "a")], "title_remainder": [("245", "b")], "title_responsibility": [("245", "c"), ("245", "d")], "pub_place": [("260", "a"), ("264", "a")], "publisher": [("260", "b"), ("264", "b")], "pub_date": [("260", "c"), ("264", "c")],
    "extent": [("300", "a")], "series_title": [("440", "a"), ("490", "a")], "note": [("500", "a")], "bibliography_note": [("504", "a")], "corporate_author": [("110", "a"), ("710", "a")], "price": [("950", "a")],
}
MARC_LISTS = {"subject": ["650"], "keyword": ["653"], "personal_author": ["100", "700"]}
MARC_CLEAN = {"isbn", "kdc", "ddc", "title", "title_remainder", "pub_place", "publisher", "extent", "series_title", "corporate_author", "personal_author"}
FIELD_END, SUBFIELD, RECORD_END = "\u001e", "\u001f", "\u001d"


def articles(sheet: DataFrame) -> DataFrame:
    """An article sheet's rows: headers in any case, rows without id dropped, counts as numbers, title else the id."""
    named = sheet.toDF(*(c.strip().upper() for c in sheet.columns))
    if "KCI_FI_ID" not in named.columns:
        raise ValueError("the sheet has no id column")
    clean = lambda c: F.when(F.trim(c) != "", F.trim(c))
    cols = {to: clean(F.col(src).cast("string")) if src in named.columns else F.lit(None).cast("string") for src, to in ARTICLE_COLUMNS.items()}
    for c in ("kci_citations", "wos_citations"):
        cols[c] = F.coalesce(F.try_to_number(cols[c], F.lit("999999999")).cast("int"), F.lit(0))
    cols["title"] = F.coalesce(cols["title"], cols["cnts_id"])
    out = named.select(*(v.alias(k) for k, v in cols.items()), F.lit("KCI").alias("source_format"), F.lit("paper").alias("genre"), F.lit("kor").alias("language"))
    return out.filter(F.col("cnts_id").isNotNull())


def read_sheet(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8", "euc-kr", "cp949", "utf-16"), separators: str = ",\t;") -> DataFrame:
    """A CSV sheet of unknown encoding and separator: the first combination whose header has two columns or more."""
    for encoding in encodings:
        for sep in separators:
            df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, quote='"', escape='"')
            if len(df.columns) > 1 and not any("�" in c for c in df.columns):
                return df
    return spark.read.csv(path, header=True)


#: Loaders by the header that shows their sheet.
LOADERS = {"KCI_FI_ID": "articles", "CONTENTS_ID": "books"}


def resolve_loader(columns: list[str]) -> str | None:
    heads = {c.strip().upper() for c in columns}
    return next((name for mark, name in LOADERS.items() if mark in heads), None)


def restore_controls(raw: Column) -> Column:
    """Control characters that a spreadsheet wrote as _xHHHH_."""
    for code in ("001D", "001E", "001F", "000D"):
        raw = F.regexp_replace(raw, f"_x{code}_", chr(int(code, 16)).replace("\\", "\\\\"))
    return raw


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def marc_fields(raw: Column) -> Column:
    """Fields (tag, data) of an ISO 2709 record whose separators are there; null for any other.

    Tags come from the directory (12 characters an entry), contents from the separators, so lengths counted in bytes
    don't matter.
    """
    def read(text: Column) -> Column:
        base = F.when(F.substring(text, 13, 5).rlike(r"^\d{5}$"), F.substring(text, 13, 5).cast("int"))
        directory = F.substr(text, F.lit(25), base - 25)
        tags = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(directory) / 12).cast("int") - 1, F.lit(0))), lambda i: F.substr(directory, i * 12 + 1, F.lit(3)))
        parts = F.filter(F.transform(F.split(F.substr(text, base + 1), FIELD_END), lambda s: F.regexp_replace(s, RECORD_END, "")), lambda s: s != "")
        n = F.least(F.size(tags), F.size(parts))
        fields = F.zip_with(F.slice(tags, 1, n), F.slice(parts, 1, n), lambda t, p: F.struct(t.alias("tag"), p.alias("data")))
        return F.when(F.contains(text, F.lit(FIELD_END)) & base.isNotNull() & (base < F.length(text)) & (n > 0), fields)

    return bound(restore_controls(F.trim(raw)), read)


def all_subfields(fields: Column, tag: str, code: str = "") -> Column:
    """Values of a subfield in all fields of a tag, empty ones left out; without a code, whole fields."""
    mine = F.filter(fields, lambda f: f["tag"] == tag)
    if not code:
        return F.transform(mine, lambda f: F.trim(f["data"]))
    sub = F.transform(mine, lambda f: F.regexp_extract(f["data"], f"{SUBFIELD}{code}([^{SUBFIELD}]*)", 1))
    return F.filter(sub, lambda s: F.trim(s) != "")


def first_subfield(fields: Column, tag: str, code: str = "") -> Column:
    """The first of them, or null."""
    return F.get(all_subfields(fields, tag, code), F.lit(0))


def marc(raw: Column) -> Column:
    """A struct of the fields of a record with separators; null fields where it has none."""
    return bound(marc_fields(raw), _marc_record)


def _marc_record(fields: Column) -> Column:
    def tidy(name: str, c: Column) -> Column:
        c = year(c) if name == "pub_date" else strip_punctuation(c) if name in MARC_CLEAN else c
        return F.when(c != "", c)

    out = [F.coalesce(*(tidy(name, first_subfield(fields, *w)) for w in where)).alias(name) for name, where in MARC_FIELDS.items()]
    for name, tags in MARC_LISTS.items():
        got = F.concat(*(all_subfields(fields, t, "a") for t in tags))
        got = F.transform(got, strip_punctuation) if name in MARC_CLEAN else got
        out.append(F.when(F.size(got) > 0, F.array_join(got, " | ")).alias(name))
    language = F.trim(F.substring(first_subfield(fields, "008"), 36, 3))
    return F.struct(*out, F.when(language != "", language).alias("language"), F.when(fields.isNotNull(), "MARC").alias("source_format"))


def marc_loose(raw: Column) -> Column:
    """Title, author and publisher of a record that lost its separators, where subfields are written $a or ▼a."""
    pick = lambda tag, code: F.regexp_extract(raw, rf"{tag}[^$▼]*(?:[$▼][^{code}][^$▼]*)*[$▼]{code}([^$▼\n]+)", 1)
    none = lambda c: F.when(c != "", strip_punctuation(c))
    return F.struct(none(pick("245", "a")).alias("title"), none(pick("(?:100|700)", "a")).alias("personal_author"), none(pick("26[04]", "b")).alias("publisher"), none(year(pick("26[04]", "c"))).alias("pub_date"))


def clean_xml(raw: Column) -> Column:
    """Without control characters, with bare ampersands escaped and without namespaces, so that plain paths work."""
    text = F.regexp_replace(restore_controls(raw), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    text = F.regexp_replace(text, r"&(?!(?:[A-Za-z]+|#\d+|#x[0-9A-Fa-f]+);)", "&amp;")
    return F.regexp_replace(F.regexp_replace(text, r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"(</?)\w+:", "$1")


_TEXT = "array<struct<_VALUE:string,_type:string,_authority:string>>"
#: The parts of a record that are read; attributes carry an underscore, and an element's own text is _VALUE.
MODS_SCHEMA = f"""titleInfo array<struct<title:string,subTitle:string,partNumber:string>>, name array<struct<_type:string,namePart:array<string>>>, typeOfResource array<string>, genre array<string>,
    originInfo array<struct<place:array<struct<placeTerm:{_TEXT}>>,publisher:array<string>,dateIssued:array<string>>>, language array<struct<languageTerm:array<string>>>,
    physicalDescription array<struct<extent:array<string>,internetMediaType:array<string>,digitalOrigin:array<string>>>, abstract array<string>, subject array<struct<topic:array<string>>>, targetAudience array<string>,
    classification {_TEXT}, identifier {_TEXT}, location array<struct<url:array<string>>>, accessCondition array<struct<_VALUE:string,licenseType:string>>,
    relatedItem array<struct<_type:string,titleInfo:array<struct<title:string>>,recordInfo:array<struct<recordIdentifier:array<string>>>>>,
    recordInfo array<struct<recordIdentifier:array<string>,recordChangeDate:array<string>>>"""
# Field -> path below the record.
MODS_PATHS = {
    "last_modified": "recordInfo.recordChangeDate", "title": "titleInfo.title", "title_remainder": "titleInfo.subTitle", "part_number": "titleInfo.partNumber", "publisher": "originInfo.publisher", "extent": "physicalDescription.extent",
    "language": "language.languageTerm", "material_type": "typeOfResource", "genre": "genre", "abstract": "abstract", "url": "location.url", "media_type": "physicalDescription.internetMediaType", "target_audience": "targetAudience",
    "digital_origin": "physicalDescription.digitalOrigin",
}


def parse_mods(raw: Column) -> Column:
    """The record as nested arrays, parsed once; attributes of plain text elements are kept only where the schema has them."""
    plain = F.regexp_replace(clean_xml(raw), r"<(languageTerm|genre|recordIdentifier|recordChangeDate|dateIssued|title|subTitle|abstract|topic|url|publisher|extent|namePart|typeOfResource|targetAudience|digitalOrigin|internetMediaType|partNumber)\s[^<>]*?(/?)>", "<$1$2>")
    return F.from_xml(plain, MODS_SCHEMA, {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"})


def mods(record: Column) -> Column:
    """A struct of fields of a record that parse_mods gave."""
    none = lambda c: F.when(F.trim(c) != "", F.trim(c))
    first = lambda a: none(F.get(F.filter(a, lambda s: F.trim(s) != ""), F.lit(0)))

    def below(step: str):
        single = step in ("title", "subTitle", "partNumber")
        return lambda x: F.filter(F.array(x[step]), lambda v: v.isNotNull()) if single else F.coalesce(x[step], F.array().cast("array<string>"))

    def at(path: str) -> Column:
        """All texts at a path of one or two steps, as one array."""
        top, *rest = path.split(".")
        return F.flatten(F.transform(record[top], below(rest[0]))) if rest else record[top]

    typed = lambda a, kind: F.transform(F.filter(a, lambda x: x["_type"] == kind), lambda x: x["_VALUE"])
    names = lambda keep: F.flatten(F.transform(F.filter(record["name"], keep), lambda n: F.slice(F.filter(n["namePart"], lambda s: F.trim(s) != ""), 1, 1)))
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(F.transform(a, lambda s: F.trim(s)), " | "))
    own = F.filter(at("recordInfo.recordIdentifier"), lambda s: s.startswith("CNTS"))
    other = F.flatten(F.transform(record["relatedItem"], lambda r: F.flatten(F.transform(r["recordInfo"], lambda i: i["recordIdentifier"]))))
    series = F.flatten(F.transform(F.filter(record["relatedItem"], lambda r: r["_type"] == "series"), lambda r: F.transform(r["titleInfo"], lambda t: t["title"])))
    places = F.flatten(F.transform(record["originInfo"], lambda o: F.flatten(F.transform(o["place"], lambda x: x["placeTerm"]))))
    classes = F.filter(record["classification"], lambda c: F.upper(c["_authority"]).startswith("KDC"))
    access = F.get(record["accessCondition"], F.lit(0))
    return F.struct(
        F.coalesce(first(own), first(other)).alias("record_id"), *(first(at(path)).alias(name) for name, path in MODS_PATHS.items()), first(typed(places, "text")).alias("pub_place"), first(typed(record["identifier"], "uci")).alias("uci"), first(series).alias("series_title"),
        F.substring(first(at("originInfo.dateIssued")), 1, 4).alias("pub_date"), joined(names(lambda n: F.coalesce(n["_type"], F.lit("")) != "corporate")).alias("personal_author"), joined(names(lambda n: n["_type"] == "corporate")).alias("corporate_author"),
        first(F.transform(classes, lambda c: c["_VALUE"])).alias("kdc"), joined(at("subject.topic")).alias("subject"), F.coalesce(none(access["_VALUE"]), none(access["licenseType"])).alias("access_condition"), F.lit("MODS").alias("source_format"),
    )


def marc_tiers(rows: DataFrame, raw: str, library: str | None = None, out: str = "record") -> DataFrame:
    """rows with title, personal_author, publisher, pub_date and tier of the record in raw, by the first way that finds
    a title: a MARC library's reading (a struct column with these fields), the separators, loose patterns.

    Blank records have none; one without a title anywhere is what the loose patterns give. Each way is a column of its
    own, so no record is parsed twice.
    """
    fields, filled = ("title", "personal_author", "publisher", "pub_date"), F.trim(F.coalesce(F.col(raw), F.lit(""))) != ""
    ways = {"library": F.col(library)} if library else {}
    read = rows.withColumns({"_separators": F.when(filled, marc(F.col(raw))), "_loose": F.when(filled, marc_loose(F.col(raw)))})
    ways |= {"separators": F.col("_separators"), "loose": F.col("_loose")}
    whole = lambda name, way: F.struct(*(way[f].alias(f) for f in fields), F.lit(name).alias("tier"))
    tried = [F.when(F.coalesce(way["title"], F.lit("")) != "", whole(name, way)) for name, way in ways.items()]
    return read.withColumn(out, F.when(filled, F.coalesce(*tried, whole("loose", ways["loose"])))).drop("_separators", "_loose")


def readable(content: Column, magic: bytes = b"%PDF") -> Column:
    """Do a file's bytes begin with the mark of its kind? An empty file doesn't."""
    return F.coalesce(F.substring(content, 1, len(magic)) == F.lit(magic), F.lit(False))


def merged_records(sheet: DataFrame) -> DataFrame:
    """Rows (CONTENTS_ID, TITLE_INFO, MARC, MODS) as records: MARC's values first, then MODS's, then the sheet's title, then the id."""
    some = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    rows = sheet.withColumn("m", F.when(some("MARC"), marc(F.col("MARC")))).withColumn("_mods", F.when(some("MODS"), parse_mods(F.col("MODS")))).withColumn("x", F.when(some("MODS"), mods(F.col("_mods"))))
    from_marc, from_mods = F.col("m.source_format").isNotNull(), F.col("x").isNotNull() & (F.col("x.title").isNotNull() | F.col("x.record_id").isNotNull())
    left, right = set(rows.schema["m"].dataType.names) - {"source_format"}, set(rows.schema["x"].dataType.names) - {"source_format"}
    both = {c: F.coalesce(*([F.col(f"m.{c}")] if c in left else []), *([F.col(f"x.{c}")] if c in right else [])) for c in sorted(left | right)}
    both["title"] = F.coalesce(both["title"], F.when(some("TITLE_INFO"), F.trim("TITLE_INFO")), F.col("CONTENTS_ID"))
    kind = F.when(from_marc & from_mods, "MARC+MODS").when(from_marc, "MARC").when(from_mods, "MODS").when(some("MARC") | some("MODS"), "ERROR").otherwise("NONE")
    return rows.filter(some("CONTENTS_ID")).select(F.trim("CONTENTS_ID").alias("cnts_id"), *(v.alias(k) for k, v in both.items()), kind.alias("source_format"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, gzip or not, of (book_id, object_key, title); blank lines don't count. seq is the order within the input."""
    rows = spark.read.schema("book_id string, object_key string, title string").json(path)
    return rows.withColumn("seq", F.monotonically_increasing_id())


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> tuple[DataFrame, DataFrame]:
    """(id, path, size, readable) of files below a folder, first path of an id; and ids found again. Spark's file source lists no empty files."""
    from stackroom.functions.biblio import clean_id
    from stackroom.operators.tables import first_wins

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    rows = found.select(clean_id(stem).alias("id"), "path", F.col("length").alias("size"), readable(F.col("content")).alias("readable"))
    return first_wins(rows, ["id"], ["path"])


def page_route(confidence: Column, text: Column, figure: Column) -> Column:
    """Which extractor a page needs: keep, diagram or ocr."""
    other = F.length(F.trim(F.regexp_replace(text, r"\[figure\]", "")))
    return F.when(text.isNotNull() & ~figure & (F.length(F.trim(text)) >= 50), "keep").when(figure & (other >= 80), "diagram").otherwise("ocr")


def page_confidence(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) >= 50, 1.0).otherwise(0.3)


def bounding_box(points: Column) -> Column:
    """left, top, right, bottom of polygon points (x, y)."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("left"), F.array_min(y).alias("top"), F.array_max(x).alias("right"), F.array_max(y).alias("bottom"))
