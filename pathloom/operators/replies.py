"""Replies in JSON: what they say, whether they keep to their form, and the repair of broken ones.

A reply is read natively; only what doesn't parse goes through Python, in Arrow batches, where a tolerant reader takes it
apart.  A reply either asks for symbols or gives an analysis; with anything else it says nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.core import compile_sql, shared

#: Fields of replies, and what names a list of symbols in running text.
SYMBOLS, ANALYSIS = "needed_functions_not_provided", "analysis"
DETAILED = ("feasibility", "feasibility_reason", "required_conditions_code", "purpose_rule_checks", "is_false_positive", "false_positive_confidence")
CHECK = ("rule_text", "check_result", "code_references")
LISTED = rf'"{SYMBOLS}"\s*:\s*\[(.*?)\]'
INLINE = r'\{[^{}]*"purpose_rule_checks"[^{}]*\}'
#: Objects in objects that the tolerant reader follows.
MAX_DEPTH = 200


class Tolerant:
    """Reads JSON with text around it, trailing or missing commas, open strings and brackets, doubled braces, raw line ends and
    unescaped quotes in strings, single quotes, words of Python, and comments."""

    SPACE = re.compile(r"(?:\s++|//[^\n]*+|/\*.*?(?:\*/|\Z))*+", re.S)
    DELIMITER = re.compile(SPACE.pattern + r"""(?:[,:\]}]|\Z|(?P<q>["'])[^"'\n]{1,99}(?P=q)\s*:)""", re.S)
    NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?=[\s,:\]}]|\Z)")
    WORD = re.compile(r"[^\s,:\[\]{}\"']+")
    WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
    ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> str:
        self.at = self.SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self, depth: int = 0):
        c = self.skip()
        if depth > MAX_DEPTH:
            raise ValueError("too deep")
        if c == "{":
            return self.object(depth)
        if c == "[":
            return self.array(depth)
        if c in ('"', "'") and c:
            return self.string(c)
        if m := self.NUMBER.match(self.text, self.at):
            self.at = m.end()
            return json.loads(m[0])
        if m := self.WORD.match(self.text, self.at):
            self.at = m.end()
            return self.WORDS.get(m[0], m[0])
        return None

    def object(self, depth: int) -> dict:
        width = 2 if self.text.startswith("{{", self.at) else 1
        self.at += width
        out = {}
        while c := self.skip():
            if c == "}":
                self.at += width if self.text.startswith("}" * width, self.at) else 1
                break
            if c in ",:":
                self.at += 1
                continue
            if c == "]":  # the object was never closed
                break
            key = self.value(depth + 1)
            if self.skip() == ":":
                self.at += 1
                if self.skip() in ("", ",", "}", "]"):
                    out[str(key)] = None
                else:
                    out[str(key)] = self.value(depth + 1)
            elif c not in "{[":
                out[str(key)] = None
        return out

    def array(self, depth: int) -> list:
        self.at += 1
        out = []
        while c := self.skip():
            if c == "]":
                self.at += 1
                break
            if c in ",:":
                self.at += 1
            elif c == "}":  # the array was never closed
                break
            else:
                out.append(self.value(depth + 1))
        return out

    def string(self, quote: str) -> str:
        """Up to the quote that a delimiter, the end or the next key follows; any other quote belongs to the text."""
        self.at += 1
        out = []
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "\\" and self.at < len(self.text):
                e = self.text[self.at]
                self.at += 1
                if e == "u" and re.fullmatch("[0-9a-fA-F]{4}", code := self.text[self.at : self.at + 4]):
                    self.at += 4
                    out.append(chr(int(code, 16)))
                else:
                    out.append(self.ESCAPES.get(e, e if e in "\"'\\/" else "\\" + e))
            elif c == quote and self.DELIMITER.match(self.text, self.at):
                break
            else:
                out.append(c)
        joined = "".join(out)
        return joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # halves of a character that were escaped each


def repaired(content: str):
    """What a broken text of JSON says: its first object or array, else None."""
    starts = [i for i in (content.find("{"), content.find("[")) if i >= 0]
    if not starts:
        return None
    reader = Tolerant(content)
    reader.at = min(starts)
    try:
        return reader.value()
    except (ValueError, RecursionError):
        return None


def unfenced(content: Column) -> Column:
    """The text without a fence of code around it: its first and last line go."""
    text = F.regexp_replace(content, r"^\s+|\s+$", "")
    lines = F.split(text, "\n")
    inner = F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n"), r"^\s+|\s+$", "")
    return F.when(text.startswith("```") & text.endswith("```") & (F.size(lines) > 1), inner).otherwise(text)


def kind_of(v: Column) -> Column:
    """The type of a JSON value: OBJECT, ARRAY, STRING ..., null for none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def said(v: Column) -> tuple[Column, Column, Column]:
    """(kind, analysis, symbols) of a parsed reply; the kind is null where it keeps to no form."""
    whole = kind_of(v) == "OBJECT"
    kind = F.when(whole & field(v, SYMBOLS).isNotNull(), "symbols").when(whole & field(v, ANALYSIS).isNotNull(), "analysis")
    listed = F.filter(F.try_variant_get(v, f"$.{SYMBOLS}", "array<string>"), lambda x: x.isNotNull())
    return kind, F.when(kind == "analysis", F.try_variant_get(v, f"$.{ANALYSIS}", "string")), F.when(kind == "symbols", listed)


def listed_symbols(content: Column) -> Column:
    """The names in the first list of symbols of a running text, null if there is none."""
    found = F.regexp_extract_all(F.regexp_extract(content, "(?s)" + LISTED, 1), F.lit('"([^"]+)"'), 1)
    return F.when(F.size(found) > 0, F.array_distinct(found))


def repair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [json.dumps(x) if (x := repaired(t)) is not None else None for t in batch.column("content").to_pylist()]
        yield pa.record_batch([batch.column("site"), batch.column("content"), pa.array(texts, pa.string())], names=["site", "content", "text"])


def parse(replies: DataFrame) -> DataFrame:
    """(site, way, kind, analysis, symbols) of every reply (site, content).

    ``way``: direct, where it parses and keeps to a form; repaired, where the tolerant reader makes one of it; listed, where a list
    of symbols stands in running text; none.  Null and empty replies say nothing.  Rows are read each by itself."""
    rows = replies.select("site", unfenced(F.coalesce("content", F.lit(""))).alias("content"))
    read = rows.withColumn("v", F.try_parse_json("content"))
    kind, analysis, symbols = said(F.col("v"))
    direct = read.select("site", F.lit("direct").alias("way"), kind.alias("kind"), analysis.alias("analysis"), symbols.alias("symbols")).where("kind is not null")
    broken = read.where(kind.isNull()).select("site", "content").mapInArrow(repair_batches, "site long, content string, text string").withColumn("v", F.try_parse_json("text"))
    late = broken.select("site", kind.alias("kind"), analysis.alias("analysis"), symbols.alias("symbols"), listed_symbols(F.col("content")).alias("listed"))
    way = F.when(F.col("kind").isNotNull(), "repaired").when(F.col("listed").isNotNull(), "listed").otherwise("none")
    late = late.select("site", way.alias("way"), F.coalesce("kind", F.when(F.col("listed").isNotNull(), "symbols")).alias("kind"), "analysis", F.coalesce("symbols", F.when(F.col("kind").isNull(), F.col("listed"))).alias("symbols"))
    return direct.unionByName(late)


def validity(replies: DataFrame) -> DataFrame:
    """(site, is_valid, mixed_quotes, braces_differ, brackets_differ, raw_escapes): whether a reply is JSON, and what may be wrong if not."""
    c = F.coalesce("content", F.lit(""))
    ok = (c != "") & F.try_parse_json(c).isNotNull()
    odd = lambda cond: ~ok & (F.trim(c) != "") & cond
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return replies.select("site", ok.alias("is_valid"), odd(F.contains(c, F.lit('"')) & F.contains(c, F.lit("'"))).alias("mixed_quotes"), odd(count("{") != count("}")).alias("braces_differ"), odd(count("[") != count("]")).alias("brackets_differ"), odd(F.contains(c, F.lit("\\n")) & ~F.contains(c, F.lit("\\\\n"))).alias("raw_escapes"))


def sound(checks: Column) -> Column:
    """Whether an array of checks is sound: objects with a text, a result and a list of references."""
    one: Callable[[Column], Column] = lambda c: F.coalesce((kind_of(c) == "OBJECT") & (kind_of(field(c, "rule_text")) == "STRING") & (kind_of(field(c, "check_result")) == "STRING") & (kind_of(field(c, "code_references")) == "ARRAY"), F.lit(False))
    return F.forall(checks, one)


def array_of(v: Column, name: str) -> Column:
    return F.when(kind_of(field(v, name)) == "ARRAY", F.try_variant_get(v, f"$.{name}", "array<variant>"))


def detailed(replies: DataFrame) -> DataFrame:
    """(site, n_missing, checks_sound, is_valid): whether a reply is a detailed result with all its fields and sound checks."""
    v = F.try_parse_json("content")
    rows = replies.withColumn("v", v).where(kind_of(F.col("v")) == "OBJECT")
    missing = sum((F.when(field(F.col("v"), n).isNull(), 1).otherwise(0) for n in DETAILED), F.lit(0)).cast("long")
    checks = F.coalesce(sound(array_of(F.col("v"), "purpose_rule_checks")), F.lit(False))
    return rows.select("site", missing.alias("n_missing"), checks.alias("checks_sound")).withColumn("is_valid", (F.col("n_missing") == 0) & F.col("checks_sound"))


def rule_checks(replies: DataFrame) -> DataFrame:
    """(site, source, pos, rule_text, check_result, n_references, first_reference) of every check that a reply holds.

    Under ``rule_checks`` older names count as well, and all checks go if one isn't sound; a detailed result has them under
    ``purpose_rule_checks``, any other object too, checked or not; and so has an object inside running text."""
    v = F.col("v")
    rows = replies.select("site", "content", F.try_parse_json("content").alias("v"))
    whole = F.coalesce(kind_of(v) == "OBJECT", F.lit(False))
    inline = F.filter(F.regexp_extract_all("content", F.lit("(?s)" + INLINE), 0), lambda t: F.try_parse_json(t).isNotNull())
    plain = lambda c: F.struct(F.try_variant_get(c, "$.rule_text", "string").alias("rule_text"), F.try_variant_get(c, "$.check_result", "string").alias("check_result"), F.try_variant_get(c, "$.code_references", "array<string>").alias("refs"), F.lit(True).alias("ok"))

    def renamed(c: Column) -> Column:
        text, result, refs = field(c, "rule_text"), F.coalesce(field(c, "check_result"), field(c, "findings")), field(c, "code_references")
        good = F.coalesce(kind_of(text) == "STRING", F.lit(True)) & F.coalesce(kind_of(result) == "STRING", F.lit(True)) & F.coalesce(kind_of(refs) == "ARRAY", F.lit(True))
        one = F.array(F.coalesce(F.try_variant_get(c, "$.what_checked", "string"), F.lit("")))
        return F.struct(F.coalesce(text.cast("string"), F.lit("")).alias("rule_text"), F.coalesce(result.cast("string"), F.lit("")).alias("check_result"), F.coalesce(F.try_variant_get(c, "$.code_references", "array<string>"), one).alias("refs"), good.alias("ok"))

    own = F.transform(F.filter(array_of(v, "rule_checks"), lambda c: kind_of(c) == "OBJECT"), renamed)
    current = F.when(F.forall(own, lambda c: c["ok"]), own)
    held = whole & field(v, "rule_checks").isNotNull()
    purpose = F.transform(array_of(v, "purpose_rule_checks"), plain)
    aside = F.transform(array_of(F.try_parse_json(F.get(inline, F.lit(0))), "purpose_rule_checks"), plain)
    full = F.lit(True)
    for n in DETAILED:
        full = full & field(v, n).isNotNull()
    source = F.when(held, "rule_checks").when(whole & full & sound(array_of(v, "purpose_rule_checks")), "detailed").when(whole, "plain").otherwise("inline")
    checks = F.when(held, current).when(whole, purpose).otherwise(aside)
    found = rows.select("site", source.alias("source"), F.posexplode(checks).alias("pos", "c"))
    return found.select("site", "source", F.col("pos").cast("long").alias("pos"), F.col("c.rule_text").alias("rule_text"), F.col("c.check_result").alias("check_result"), F.size("c.refs").cast("long").alias("n_references"), F.get("c.refs", F.lit(0)).alias("first_reference"))


def needed_symbols(replies: DataFrame) -> DataFrame:
    """(site, name): symbols that a reply asks for, from its field or from a list in running text."""
    v = F.try_parse_json("content")
    field_list = F.when(kind_of(v) == "OBJECT", F.try_variant_get(v, f"$.{SYMBOLS}", "array<string>"))
    names = F.coalesce(field_list, listed_symbols(F.col("content")))
    return replies.select("site", F.explode(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))).alias("name"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, "reply", {"conversations": spark.read.parquet(f"{sf_dir}/conversations.parquet")})


def reply_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(_replies(spark, sf_dir)).withColumn("symbols", F.array_join(F.array_sort("symbols"), ","))


def reply_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_parsed(spark, sf_dir).where("way = 'direct'").drop("way")


def reply_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity(_replies(spark, sf_dir))


def reply_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detailed(_replies(spark, sf_dir))


def reply_rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_checks(_replies(spark, sf_dir))


def reply_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return needed_symbols(_replies(spark, sf_dir))


QUERIES = (reply_parsed, reply_direct, reply_validity, reply_detailed, reply_rule_checks, reply_symbols)


def oracles() -> dict[str, str]:
    head = "with reply as (" + compile_sql("reply", "duckdb") + "),\n"
    ok = head + "t as (select site, content, case when json_valid(content) then cast(content as json) end as j from reply)\n"
    inner = "array_to_string(list_slice(string_split(trim(content, chr(10) || ' '), chr(10)), 2, -2), chr(10))"
    return {
        "reply_direct": head + f"""u as (select site, case when trim(content, chr(10) || ' ') like '```%```' then {inner} else content end as c from reply),
            t as (select site, cast(c as json) as j from u where json_valid(c)),
            k as (select *, case when json_type(j) <> 'OBJECT' then null when json_exists(j, '$.{SYMBOLS}') then 'symbols' when json_exists(j, '$.{ANALYSIS}') then 'analysis' end as kind from t)
            select site, kind, case when kind = 'analysis' then json_extract_string(j, '$.{ANALYSIS}') end as analysis,
                   case when kind = 'symbols' then array_to_string(list_sort(json_extract_string(j, '$.{SYMBOLS}[*]')), ',') end as symbols from k where kind is not null""",
        "reply_validity": head + """n as (select site, content as c, content <> '' and json_valid(content) as ok from reply)
            select site, ok as is_valid, not ok and trim(c) <> '' and contains(c, '"') and contains(c, '''') as mixed_quotes,
                   not ok and trim(c) <> '' and length(replace(c, '{', '')) <> length(replace(c, '}', '')) as braces_differ,
                   not ok and trim(c) <> '' and length(replace(c, '[', '')) <> length(replace(c, ']', '')) as brackets_differ,
                   not ok and trim(c) <> '' and contains(c, chr(92) || 'n') and not contains(c, chr(92) || chr(92) || 'n') as raw_escapes from n""",
        "reply_detailed": ok + ", d as (select site, j, " + " + ".join(f"cast(not json_exists(j, '$.{n}') as bigint)" for n in DETAILED) + """ as n_missing from t where json_type(j) = 'OBJECT'),
            s as (select site, bool_and(coalesce(json_type(c) = 'OBJECT' and json_type(c, '$.rule_text') = 'VARCHAR' and json_type(c, '$.check_result') = 'VARCHAR' and json_type(c, '$.code_references') = 'ARRAY', false)) as sound
                  from (select site, unnest(json_extract(j, '$.purpose_rule_checks[*]')) as c from d) x group by site)
            select d.site, d.n_missing, coalesce(json_type(d.j, '$.purpose_rule_checks') = 'ARRAY', false) and coalesce(s.sound, true) as checks_sound, d.n_missing = 0 and coalesce(json_type(d.j, '$.purpose_rule_checks') = 'ARRAY', false) and coalesce(s.sound, true) as is_valid
            from (select * from d) d left join s on s.site = d.site""",
        "reply_symbols": ok + f""", a as (select site, case when json_type(j) = 'OBJECT' and json_exists(j, '$.{SYMBOLS}') then json_extract_string(j, '$.{SYMBOLS}[*]')
                   else regexp_extract_all(regexp_extract(content, '"{SYMBOLS}"[ \\n]*:[ \\n]*\\[([^\\]]*)\\]', 1), '"([^"]+)"', 1) end as names from t)
            select distinct site, name from (select site, unnest(names) as name from a) x""",
        "reply_rule_checks": ok + """, f as (select site, j, case when json_type(j) = 'OBJECT' and json_exists(j, '$.rule_checks') then 'rule_checks' when json_exists(j, '$.feasibility') then 'detailed' else 'plain' end as source from t where json_type(j) = 'OBJECT'),
            l as (select site, source, case when source = 'rule_checks' then json_extract(j, '$.rule_checks[*]') else json_extract(j, '$.purpose_rule_checks[*]') end as cs from f),
            c as (select site, source, unnest(cs) as c, generate_subscripts(cs, 1) - 1 as pos from l)
            select site, source, cast(pos as bigint) as pos, coalesce(json_extract_string(c, '$.rule_text'), case when source = 'rule_checks' then '' end) as rule_text,
                   coalesce(json_extract_string(c, '$.check_result'), case when source = 'rule_checks' then coalesce(json_extract_string(c, '$.findings'), '') end) as check_result,
                   case when json_exists(c, '$.code_references') then cast(json_array_length(c, '$.code_references') as bigint) when source = 'rule_checks' then 1 end as n_references,
                   coalesce(json_extract_string(c, '$.code_references[0]'), case when source = 'rule_checks' and not json_exists(c, '$.code_references') then coalesce(json_extract_string(c, '$.what_checked'), '') end) as first_reference
            from c""",
    }
