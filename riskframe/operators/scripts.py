"""Script-language sources as a table of tokens: bracket depths, exports with their parameters, call sites of libraries.

A file is cut into tokens by one pattern, exploded, and from then on everything is windows over (file, position): the running
depth of brackets, the partner of each bracket (the next bracket of its level), the words around a token. Strings and
comments are single tokens, so nothing within them counts. Texts are dealt by file before they are cut, so all windows share that
partitioning and tokens aren't shuffled. Call sites are one chain from text to row, without a table of tokens between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import stage

IDENT = r"[A-Za-z_$][\w$]*"
COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
STRING = r'"(?:\\[\s\S]|[^"\\\n])*"|' + r"'(?:\\[\s\S]|[^'\\\n])*'|" + r"`(?:\\[\s\S]|[^`\\])*`"
# A token with the blanks before it.
TOKEN = rf"\s*(?:{COMMENT}|{STRING}|{IDENT}|\d[\w.]*|=>|\.\.\.|\?\.|[\s\S])"
BLANKS = " \t\n\x0b\f\r"

SCRIPT_PATH = r"\.(js|jsx|mjs|cjs|ts|tsx|mts|cts)$"
FILE = ["repo_id", "path"]
FILES_A_TASK = 20_000


def _dealt(files: DataFrame) -> DataFrame:
    """The files dealt by name: what is windowed or grouped by file later stays in its task. Tasks follow the number of files."""
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(max(least, -(-files.count() // FILES_A_TASK)), *FILE)


def script_tokens(files: DataFrame) -> DataFrame:
    """One row per token of the script files ``(repo_id, path, text)`` that is not blank, comments left out.

    repo_id, path, pos, tok, line, spaced (a blank or comment stands before it), doc (the comment before it), depth (open
    brackets before it), level (for brackets: the depth within), close (for opening brackets: the position of the partner,
    null if it is never closed). Null and empty texts have no tokens.
    """
    order = Window.partitionBy(*FILE).orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    step = F.when(F.col("tok").isin("(", "[", "{"), 1).when(F.col("tok").isin(")", "]", "}"), -1).otherwise(0)
    comment = lambda c: c.startswith("//") | c.startswith("/*")
    texts = _dealt(files.where(F.rlike("path", F.lit(SCRIPT_PATH))).select(*FILE, "text"))
    rows = (
        texts.select(*FILE, F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "_cut"))
        .withColumn("tok", F.ltrim("_cut", F.lit(BLANKS)))
        .withColumns({"step": step, "_all": breaks(F.col("_cut")), "_own": breaks(F.col("tok"))})
        .withColumns(
            {
                "line": (1 + F.coalesce(F.sum("_all").over(before), F.lit(0)) + F.col("_all") - F.col("_own")).cast("int"),
                "depth": F.coalesce(F.sum("step").over(before), F.lit(0)).cast("int"),
                "doc": F.lag("tok").over(order),
            }
        )
        .withColumn("spaced", (F.length("_cut") > F.length("tok")) | F.coalesce(comment(F.col("doc")), F.lit(False)))
        .withColumn("doc", F.when(F.col("doc").startswith("/*"), F.col("doc")))
        .where((F.col("tok") != "") & ~comment(F.col("tok")))
        .withColumn("level", F.when(F.col("step") != 0, F.col("depth") + F.greatest("step", F.lit(0))))
    )
    same_level = Window.partitionBy(*FILE, "level").orderBy("pos")
    close = F.when(F.col("step") == 1, F.when(F.lead("step").over(same_level) == -1, F.lead("pos").over(same_level)))
    return rows.withColumn("close", close).select(*FILE, "pos", "tok", "line", "spaced", "doc", "depth", "level", "close")


def _joined(tokens: Column) -> Column:
    """The text of tokens ``(pos, spaced, tok)`` in order, each run of blanks as one."""
    return F.trim(F.array_join(F.transform(tokens, lambda t: F.concat(F.when(t["spaced"], " ").otherwise(""), t["tok"])), ""))


def _pieces(tokens: DataFrame, opens: DataFrame, angles: bool) -> DataFrame:
    """The parts between the commas of each bracket of ``opens(repo_id, path, open, close, inside)``: repo_id, path, open, piece, toks.

    ``inside`` is the depth within the bracket. With ``angles``, ``<`` and ``>`` are brackets as well (types). Every token
    belongs to each bracket around it that is asked for; a part without tokens has no row.
    """
    # Brackets asked for are those of export heads: few to a file, and not within each other.
    ends = opens.withColumnRenamed("close", "_end")
    held = tokens.join(ends, FILE).where((F.col("pos") > F.col("open")) & (F.col("pos") < F.col("_end")))
    each = Window.partitionBy(*FILE, "open").orderBy("pos")
    before = each.rowsBetween(Window.unboundedPreceding, -1)
    angle = F.when(F.col("tok") == "<", 1).when(F.col("tok") == ">", -1).otherwise(0) if angles else F.lit(0)
    comma = (F.col("tok") == ",") & (F.col("depth") == F.col("inside")) & (F.col("_angle") <= 0)
    numbered = (
        held.withColumn("_angle", F.coalesce(F.sum(angle).over(before), F.lit(0)))
        .withColumn("_comma", comma)
        .withColumn("piece", F.coalesce(F.sum(F.col("_comma").cast("int")).over(before), F.lit(0)).cast("int"))
        .where(~F.col("_comma"))
    )
    flat = (F.col("depth") == F.col("inside")) & (F.col("_angle") <= 0)
    return numbered.groupBy(*FILE, "open", "piece").agg(
        F.array_sort(F.collect_list(F.struct("pos", "spaced", "tok", flat.alias("flat")))).alias("toks")
    )


def _heads(tokens: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Statements from a ``start`` token to the first ``stop`` token after it (it included): repo_id, path, pos, line, doc, head, last, close, depth.

    ``head`` is the text, ``last`` the position of the stop token, ``close`` its partner, ``depth`` that before it."""
    order = Window.partitionBy(*FILE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = tokens.withColumn("_at", F.max(F.when(start, F.col("pos"))).over(order)).where(F.col("_at").isNotNull())
    within = Window.partitionBy(*FILE, "_at").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    open_ = marked.withColumn("_done", F.coalesce(F.max((stop & (F.col("pos") > F.col("_at"))).cast("int")).over(within), F.lit(0))).where("_done = 0")
    first = F.struct("line", "doc")
    last = F.struct("pos", "close", "depth")
    return (
        open_.groupBy(*FILE, F.col("_at").alias("pos"))
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "spaced", "tok"))).alias("_toks"),
            F.min_by(first, "pos").alias("_first"),
            F.max_by(last, "pos").alias("_last"),
        )
        .select(
            *FILE, "pos", "_first.line", "_first.doc", _joined(F.col("_toks")).alias("head"),
            F.col("_last.pos").alias("last"), F.col("_last.close").alias("close"), F.col("_last.depth").alias("depth"),
        )
    )


# ------------------------------------------------------------------------------------------- exports
_NAME = rf"({IDENT})"
_TYPES = r"(?:<[^()]*> ?)?"
FUNCTION_HEAD = rf"^export (?:declare )?(?:default )?(?:async )?function ?\*? ?{_NAME} ?{_TYPES}\($"
VALUE_HEAD = rf"^export (?:declare )?(?:const|let|var) {_NAME} ?(?::[^=;]*)?= ?(?:async ?)?(?:function ?\*? ?[\w$]* ?)?{_TYPES}\($"
COMMON_HEAD = rf"^(?:module\.)?exports\.{_NAME} ?= ?(?:async ?)?(?:function ?\*? ?[\w$]* ?)?\($"
CLASS_HEAD = rf"^export (?:declare )?(?:default )?(?:abstract )?class {_NAME}"
LIST_HEAD = r"^(?:export (?:type )?|export|module\.exports ?= ?)\{$"


def _parameter(toks: Column) -> Column:
    """Name, kind and default of a parameter's tokens."""
    text = _joined(toks)
    rest = text.startswith("...")
    plain = F.regexp_extract(text, rf"^(?:\.\.\. ?)?{_NAME}", 1)
    name = F.when(plain != "", plain).when(text.startswith("{"), "{…}").when(text.startswith("["), "[…]").otherwise(text)
    equals = F.filter(toks, lambda t: t["flat"] & (t["tok"] == "="))
    given = _joined(F.filter(toks, lambda t: t["pos"] > F.get(equals, F.lit(0))["pos"]))
    optional = F.when(F.rlike(text, F.lit(rf"^(?:\.\.\. ?)?{IDENT} ?\?")), F.lit("undefined"))
    return F.struct(
        name.alias("name"),
        F.when(rest, "var").otherwise("pos").alias("kind"),
        F.when(F.size(equals) > 0, given).otherwise(optional).alias("default"),
    )


def script_exports(files: DataFrame) -> DataFrame:
    """Exported names of script files; ``repo_id`` names the library. library, name, kind, file, line, params, deprecated.

    Functions (declared, assigned, or put on ``exports``) carry their parameters, whatever brackets these hold: nested
    defaults, destructured parameters (named by their bracket), types with commas. Parameters of a bracket that never closes
    are null. Names of export lists are of kind ``export`` and only count where nothing else exports them. Of a name exported twice the
    first with parameters counts, by file and place; declaration files win. ``deprecated``: a doc comment before it says so.
    """
    sources = files.where(~F.rlike("path", F.lit(r"\.(test|spec|stories)\.")))
    tokens = stage(script_tokens(sources))
    word = F.col("tok").isin("export", "module", "exports") & (F.lag("tok").over(Window.partitionBy(*FILE).orderBy("pos")).isNull() | (F.lag("tok").over(Window.partitionBy(*FILE).orderBy("pos")) != "."))
    marked = tokens.withColumn("_start", word)
    heads = stage(_heads(marked, F.col("_start"), F.col("tok").isin("(", "{", ";")))

    def named(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("head", pattern, 1), F.lit(""))

    function = F.coalesce(*[named(p) for p in (FUNCTION_HEAD, VALUE_HEAD, COMMON_HEAD)])
    found = heads.withColumns({"_function": function, "_class": named(CLASS_HEAD), "_list": F.rlike("head", F.lit(LIST_HEAD))})
    doc = F.coalesce(F.contains("doc", F.lit("@deprecated")) & F.col("doc").startswith("/**"), F.lit(False))
    base = [*FILE, "pos", "line", doc.alias("deprecated")]

    functions = found.where("_function is not null")
    opens = functions.select(*FILE, F.col("last").alias("open"), "close", (F.col("depth") + 1).alias("inside")).where("close is not null")
    parts = _pieces(tokens, opens, angles=True)
    params = (
        parts.select(*FILE, "open", "piece", _parameter(F.col("toks")).alias("param"))
        .where(F.col("param.name") != "this")
        .groupBy(*FILE, "open")
        .agg(F.array_sort(F.collect_list(F.struct("piece", "param"))).alias("_params"))
        .select(*FILE, F.col("open").alias("last"), F.col("_params.param").alias("params"))
    )
    with_params = functions.join(params, [*FILE, "last"], "left").select(
        *base,
        F.col("_function").alias("name"),
        F.lit("function").alias("kind"),
        F.coalesce("params", F.when(F.col("close").isNotNull(), F.array().cast(params.schema["params"].dataType))).alias("params"),
    )
    none = F.lit(None).cast(params.schema["params"].dataType).alias("params")
    classes = found.where("_class is not null").select(*base, F.col("_class").alias("name"), F.lit("class").alias("kind"), none)
    lists = found.where("_list and close is not null")
    listed = _pieces(tokens, lists.select(*FILE, F.col("last").alias("open"), "close", (F.col("depth") + 1).alias("inside")), angles=False)
    text = _joined(F.col("toks"))
    outer = F.regexp_extract(text, rf"^(?:type )?(?:{IDENT} as )?{_NAME} ?(?::|$|\()", 1)
    names = (
        listed.select(*FILE, F.col("open").alias("last"), F.nullif(outer, F.lit("")).alias("name"))
        .where("name is not null")
        .join(lists.select(*FILE, "last", "pos", "line", "doc"), [*FILE, "last"])
        .select(*base, "name", F.lit("export").alias("kind"), none)
    )
    declaration = ~F.endswith("path", F.lit(".d.ts"))
    rank = F.struct(F.col("kind") == "export", declaration, F.col("params").isNull(), "path", "pos")
    best = (
        with_params.unionByName(classes)
        .unionByName(names)
        .groupBy("repo_id", "name")
        .agg(F.min_by(F.struct("kind", "path", "line", "params", "deprecated"), rank).alias("_b"))
    )
    return best.select(
        F.col("repo_id").alias("library"),
        F.concat_ws(".", "repo_id", "name").alias("name"),
        "_b.kind",
        F.col("_b.path").alias("file"),
        "_b.line",
        "_b.params",
        "_b.deprecated",
    )


# ---------------------------------------------------------------------------------------- call sites
def _bindings(head: Column) -> tuple[Column, Column]:
    """Specifier of a statement's text and its bindings: local name, member (null: the package itself), default."""
    quoted = r"[\"']([^\"']+)[\"']$"
    imported = rf"^import (?:type )?(?:{_NAME} ?,? ?)?(?:\{{([^}}]*)\}} ?)?(?:\* ?as {_NAME} )?from ?{quoted}"
    required = rf"^(?:const|let|var) {_NAME} ?= ?require\( ?{quoted}"
    unpacked = rf"^(?:const|let|var) ?\{{([^}}]*)\}} ?= ?require\( ?{quoted}"
    pick = lambda pattern, group: F.nullif(F.trim(F.regexp_extract(head, pattern, group)), F.lit(""))
    pair = lambda local, member, default: F.struct(local.alias("local"), member.alias("member"), F.lit(default).alias("default"))
    none = F.lit(None).cast("string")

    def members(braces: Column, between: str) -> Column:
        parts = F.filter(F.transform(F.split(F.coalesce(braces, F.lit("")), ","), lambda p: F.regexp_replace(F.trim(p), "^type ", "")), lambda p: p != "")
        sides = F.transform(parts, lambda p: F.split(p, between))
        return F.transform(sides, lambda s: pair(F.trim(F.element_at(s, -1)), F.trim(s[0]), False))

    def one(value: Column, member: Column, default: bool) -> Column:
        return F.when(value.isNotNull(), F.array(pair(value, member, default))).otherwise(F.array().cast("array<struct<local:string,member:string,default:boolean>>"))

    bound = F.concat(
        one(pick(imported, 1), none, True),
        one(pick(imported, 3), none, False),
        members(pick(imported, 2), " as "),
        one(pick(required, 1), none, True),
        members(pick(unpacked, 1), ":"),
    )
    return F.coalesce(pick(imported, 4), pick(required, 2), pick(unpacked, 2)), bound


def _sites(tokens: DataFrame) -> DataFrame:
    """Tokens with what call sites need of them; others are left out.

    _at: the statement that binds names whose text the token belongs to, or the last one before it; _head: it belongs to it. _site, on the
    bracket of a call or on a word that is none: line, local, before (the token before it), member (null: the word itself is called),
    call, args (parts between the bracket's commas; null if it never closes).
    """
    order = Window.partitionBy(*FILE).orderBy("pos")
    so_far, before = (order.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    tok = F.col("tok")
    start, stop = tok.isin("import", "const", "let", "var"), F.rlike("tok", F.lit(r"^[\"'`]|^;$"))
    word = F.rlike("tok", F.lit(rf"^{IDENT}$"))
    around = {f"_b{i}": F.lag(F.struct("tok", "line", "_word"), i).over(order) for i in (1, 2, 3, 4)}
    around |= {f"_n{i}": F.lead(F.struct("tok", "_word"), i).over(order) for i in (1, 2, 3)}
    ends = {"_at": F.max(F.when(start, F.col("pos"))).over(so_far), "_stop": F.max(F.when(stop, F.col("pos"))).over(before)}
    near = tokens.withColumn("_word", word).withColumns(around | ends)
    nothing = F.lit("")
    b = {i: F.coalesce(F.col(f"_b{i}.tok"), nothing) for i in (1, 2, 3, 4)}
    n = {i: F.coalesce(F.col(f"_n{i}.tok"), nothing) for i in (1, 2, 3)}
    site = lambda line, local, previous, member, call: F.struct(
        line.alias("line"), local.alias("local"), previous.alias("before"), member.alias("member"), F.lit(call).alias("call")
    )
    bracket, dot = tok == "(", [".", "?."]
    direct = bracket & F.col("_b1._word") & ~b[2].isin(dot)
    called = bracket & F.col("_b1._word") & (b[2] == ".") & F.col("_b3._word") & ~b[4].isin(dot)
    named = F.col("_word") & ~b[1].isin(dot) & (n[1] == ".") & F.col("_n2._word") & (n[3] != "(")
    found = (
        F.when(direct, site(F.col("_b1.line"), b[1], b[2], F.lit(None).cast("string"), True))
        .when(called, site(F.col("_b3.line"), b[3], b[4], b[1], True))
        .when(named, site(F.col("line"), tok, b[1], n[2], False))
    )
    head = F.col("_at").isNotNull() & ~F.coalesce(F.col("_stop") > F.col("_at"), F.lit(False))
    # A part begins after an opening bracket or a comma, if anything but a comma or the bracket's end follows.
    opens, comma = tok.isin("(", "[", "{"), tok == ","
    begins = ((opens | comma) & ~n[1].isin("", ",", ")", "]", "}")).cast("int")
    kept = near.select(
        *FILE, "pos", "tok", "line", "spaced", "_at", head.alias("_head"), found.alias("_found"), begins.alias("_begins"),
        F.when(comma, F.col("depth")).otherwise(F.col("level")).alias("_level"),
        F.when(F.col("level").isNotNull(), opens).alias("_opens"),
    ).where("_head or _found is not null or _level is not null")
    same_level = Window.partitionBy(*FILE, "_level").orderBy("pos")
    counted = kept.withColumn("_parts", F.sum("_begins").over(same_level.rowsBetween(Window.unboundedPreceding, 0)))
    partner = "lead(if(_opens is not null, struct(_opens, _parts), null)) ignore nulls over (partition by repo_id, path, _level order by pos)"
    args = F.when(~F.col("_next._opens"), (F.col("_next._parts") - F.col("_parts") + F.col("_begins")).cast("int"))
    return counted.withColumn("_next", F.expr(partner)).select(
        *FILE, "pos", "tok", "line", "spaced", "_at", "_head",
        F.when(F.col("_found").isNotNull(), F.struct("_found.*", F.when(F.col("_found.call"), args).alias("args"))).alias("_site"),
    )


def script_usages(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Where script files use packages: project_id, library, file, line, usage_kind, symbol, positional.

    ``packages(library)`` are the names imported from, with any path behind them. Bindings (default, namespace, named and renamed imports,
    required packages and their unpacked members) are matched with the file's words by local name: ``local.member(`` and
    ``local(`` are calls, other ``local.member`` references of a namespace. ``positional`` counts a call's arguments at
    bracket depth 0; null if the bracket never closes. Declaration files have no usages.
    """
    tokens = _sites(script_tokens(files.where(~F.endswith("path", F.lit(".d.ts")))))
    text = _joined(F.array_sort(F.collect_list(F.when(F.col("_head"), F.struct("pos", "spaced", "tok")))))
    first = F.min_by("line", "pos").alias("line")
    statements = tokens.groupBy(*FILE, "_at").agg(text.alias("head"), first, F.collect_list("_site").alias("_sites"))
    spec, bound = _bindings(F.col("head"))
    package = F.regexp_extract(spec, r"^((?:@[^/]+/)?[^/]+)", 1)
    names = F.transform(bound, lambda b: F.struct(b["local"], b["member"], b["default"], package.alias("library"), F.col("line")))
    held = statements.select(*FILE, F.when(spec.isNotNull(), names).alias("_names"), "_sites")
    whole = held.groupBy(*FILE).agg(F.flatten(F.collect_list("_names")).alias("_names"), F.flatten(F.collect_list("_sites")).alias("_sites"))
    none = F.lit(None)

    def row(library: Column, line: Column, kind: Column, symbol: Column, args: Column) -> Column:
        return F.struct(
            library.alias("library"), line.alias("line"), kind.alias("usage_kind"), symbol.alias("symbol"), args.cast("int").alias("positional")
        )

    imports = F.array_distinct(
        F.transform("_names", lambda b: row(b["library"], b["line"], F.lit("import"), F.concat_ws(".", b["library"], b["member"]), none))
    )
    distinct = F.array_distinct(F.transform("_names", lambda b: F.struct(b["local"], b["library"], b["member"], b["default"])))

    def uses(s: Column) -> Column:
        own = s["member"].isNull() & ~s["before"].isin("function", "import")
        fits = lambda b: (b["local"] == s["local"]) & F.when(b["member"].isNull(), s["member"].isNotNull() | (own & b["default"])).otherwise(own)
        said = lambda b: F.coalesce(s["member"], b["member"], F.lit("default"))
        kind = F.when(s["call"], "call").otherwise("reference")
        return F.transform(F.filter("_bound", fits), lambda b: row(b["library"], s["line"], kind, F.concat_ws(".", b["library"], said(b)), s["args"]))

    met = F.filter("_sites", lambda s: F.array_contains("_locals", s["local"]))
    rows = (
        whole.where(F.size("_names") > 0)
        .select(*FILE, imports.alias("_imports"), distinct.alias("_bound"), F.col("_names.local").alias("_locals"), "_sites")
        .select(*FILE, F.inline(F.concat("_imports", F.flatten(F.transform(met, uses)))))
    )
    known = stage(packages.select("library").distinct())
    return rows.join(known, "library", "left_semi").select(
        F.col("repo_id").alias("project_id"), "library", F.col("path").alias("file"), "line", "usage_kind", "symbol", "positional"
    )
