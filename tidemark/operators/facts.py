"""Facts out of source text: selectors, locators, expressions, types, target conventions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import as_col, trim_all
from tidemark.operators.ordered import bucketed, last_known, running_sum

# Quoted text as runs between escapes in a possessive loop: the JVM matches it without recursion.
LITERAL = r"\"[^\"\\]*(?:\\.[^\"\\]*)*+\""
#: A name with ``By`` at its front, its member if any, and the quoted text handed to it: all that a call is given, or what follows a comma.
NAMED_LITERAL = rf"(?<![A-Za-z0-9_])(By[A-Za-z]*)\s*(?:\.\s*([A-Za-z_]+)\s*)?(?:\((?=\s*{LITERAL}\s*\))|,)\s*({LITERAL})"
# Names of the locator factories in lower case without underscores, and their common kinds.
SELECTOR_KINDS = {
    "id": "Id", "cssselector": "CssSelector", "xpath": "XPath", "name": "Name", "classname": "ClassName", "tagname": "TagName",
    "linktext": "LinkText", "partiallinktext": "PartialLinkText", "bytid": "TestId", "bytestid": "TestId", "bydatatid": "TestId",
}
# Methods of generated code that make a locator.
LOCATOR_CALLS = ("Locator", "GetByTestId", "GetByText", "GetByRole")
FIRST_STRING = rf"{LITERAL}|'[^'\\]*(?:\\.[^'\\]*)*+'"


def unescape_quotes(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'"))


def common_kind(name: Column) -> Column:
    """Common kind of a locator factory, null for other names."""
    lookup = F.create_map(*[F.lit(x) for kv in SELECTOR_KINDS.items() for x in kv])
    return F.try_element_at(lookup, F.lower(F.replace(name, F.lit("_"), F.lit(""))))


def assigned_name(before: Column) -> Column:
    """The name that stands left of the last assignment of ``before``, at most two names deep, else empty."""
    left = F.when(F.contains(before, F.lit("=")), F.regexp_replace(before, r"=[^=]*$", "")).otherwise("")
    return F.regexp_extract(left, r"((?:(?:this|self|cls)\.)?[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)\s*$", 1)


def extract_selectors(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Selector facts: kind, value and the name the selector is assigned to."""
    line = F.col(line_col)
    parts = F.arrays_zip(*[F.regexp_extract_all(line, F.lit(NAMED_LITERAL), F.lit(g)).alias(n) for g, n in enumerate(("m", "by", "member", "v"))])
    kind = lambda x: common_kind(F.when(x["member"] != "", x["member"]).otherwise(x["by"]))
    known = F.filter(F.transform(parts, lambda x: F.struct(x["m"].alias("m"), x["v"].alias("v"), kind(x).alias("kind"))), lambda x: x["kind"].isNotNull())
    hits = lines.where(F.contains(line, F.lit("By"))).select(*lines.columns, F.explode(known).alias("_f"))
    name = assigned_name(F.substring(line, F.lit(1), F.position(F.col("_f.m"), line) - 1))
    value = unescape_quotes(F.substring(F.col("_f.v"), F.lit(2), F.length("_f.v") - 2))
    return hits.select(
        *lines.columns,
        F.col("_f.kind").alias("kind"),
        value.alias("value"),
        F.when(name != "", name).otherwise(F.concat(F.lit("selector:"), F.col("_f.kind"), F.lit(":"), value)).alias("source_expr"),
    )


def extract_locators(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Generated locator facts: the locator text up to the end of its statement, its method and the value it looks for."""
    statements = F.filter(F.split(F.col(line_col), ";"), lambda s: F.contains(s, F.lit("age.")))
    chain = lambda s, g: F.regexp_extract(s, rf"(?<![A-Za-z0-9_])([Pp]age\.({'|'.join(LOCATOR_CALLS)})\s*\((.+)\))", g)
    cut = F.filter(F.transform(statements, lambda s: F.struct(chain(s, 1).alias("l"), chain(s, 2).alias("m"), chain(s, 3).alias("a"))), lambda x: x["l"] != "")
    hits = lines.where(F.contains(F.lower(F.col(line_col)), F.lit("page."))).select(*lines.columns, F.explode(cut).alias("_f"))
    args = F.col("_f.a")
    quoted = F.regexp_extract(args, FIRST_STRING, 0)
    text = F.when(quoted != "", unescape_quotes(F.substring(quoted, F.lit(2), F.length(quoted) - 2))).otherwise(trim_all(args))
    is_xpath = (F.col("_f.m") == "Locator") & F.startswith(F.lower(text), F.lit("xpath="))
    return hits.select(
        *lines.columns,
        trim_all(F.col("_f.l")).alias("locator"),
        F.col("_f.m").alias("locator_kind"),
        F.when(is_xpath, F.substring(text, 7, 2**31 - 1)).otherwise(text).alias("target"),
    )


# --- masked code and dotted expressions ----------------------------------------------------------

# Possessive loops: the JVM matches them by iteration, so no text is long enough to exhaust the stack.
LINE_COMMENT = r"//[^\n]*"
BLOCK_COMMENT = r"/\*(?:[^*]*\*+(?:[^/*][^*]*\*+)*+/|[\s\S]*)"
DOUBLE_TEXT = r"\"[^\"\\]*(?:\\+[^\\][^\"\\]*)*+(?:\"|\\*\z)"
SINGLE_TEXT = r"'[^'\\]*(?:\\+[^\\][^'\\]*)*+(?:'|\\*\z)"
CODE_TOKENS = rf"{LINE_COMMENT}|{BLOCK_COMMENT}|{DOUBLE_TEXT}|{SINGLE_TEXT}|[^/\"']+|/"


def mask_code(c: Column | str) -> Column:
    """Comments and string literals blanked out, length and line breaks kept.

    The text is cut into comments, literals and code runs; the first two lose every
    character but the newline. All of it is one Column expression, no Python.
    """
    tokens = F.regexp_extract_all(as_col(c), F.lit(CODE_TOKENS), F.lit(0))
    hidden = lambda t: F.rlike(t, F.lit(r"^(?://|/\*|\"|')"))
    return F.array_join(F.transform(tokens, lambda t: F.when(hidden(t), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)), "")


# An explicit look-behind instead of a word boundary: boundaries of non-ASCII words differ between JDKs.
EXPRESSION = r"(?<![\p{L}\p{N}_])([a-z][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*+)"
NOISE_ROOTS = ("this", "base", "Task", "DateTime", "TimeSpan", "String", "Math", "Guid", "System", "Console")
NOISE_PARTS = ("Should", "Assert")


def extract_expressions(
    lines: DataFrame, line_col: str = "line", noise_roots: Sequence[str] = NOISE_ROOTS, noise_parts: Sequence[str] = NOISE_PARTS
) -> DataFrame:
    """Dotted expressions ``root.member...`` of masked lines, without well-known roots and assertions."""
    hits = lines.where(F.contains(F.col(line_col), F.lit("."))).withColumn(
        "expression", F.explode(F.regexp_extract_all(F.col(line_col), F.lit(EXPRESSION), F.lit(1)))
    )
    kept = ~F.substring_index("expression", ".", 1).isin(*noise_roots)
    for part in noise_parts:
        kept = kept & ~F.contains(F.col("expression"), F.lit(part))
    return hits.where(kept)


# --- types and target conventions -----------------------------------------------------------------

CLASS_LINE = r"^\s*(?:(?:public|internal|private|protected|abstract|sealed|static|partial)\s+)*class\s+(\w+)(?:\s*:\s*([\w<>,\s.]+?))?\s*(?:\{|$)"
NAMESPACE_LINE = r"^\s*namespace\s+([\w.]+)"
USING_LINE = r"^\s*using\s+([\w.]+)\s*;"
ATTRIBUTE = r"\[(\w+(?:\([^)]*\))?)\]"


#: Lines of a file that one task looks at together.
LINES = 1024


def extract_types(lines: DataFrame, keys: Sequence[str], ord_col: str = "line_no", line_col: str = "line") -> DataFrame:
    """Class facts with base class, namespace, and the attributes on the lines right above.

    Attribute lines belong to the next class when only attribute or blank lines lie
    between: a running count of other lines gives the run. Counts and namespaces run in slices of a file with
    what came before carried in, so one long file spreads over tasks.
    """
    line = trim_all(line_col)
    name = F.regexp_extract(line, CLASS_LINE, 1)
    base = trim_all(F.substring_index(F.regexp_extract(line, CLASS_LINE, 2), ",", 1))
    is_class = name != ""
    is_attr = ~is_class & (F.startswith(line, F.lit("[")) | F.contains(line, F.lit("]")))
    facts = lines.select(
        *keys, F.col(ord_col).alias("line_no"), name.alias("class_name"), F.nullif(base, F.lit("")).alias("base_class"),
        is_class.alias("_class"), is_attr.alias("_attr"), (F.length(line) == 0).alias("_blank"),
        F.nullif(F.regexp_extract(line, NAMESPACE_LINE, 1), F.lit("")).alias("_ns"),
        F.when(is_attr, F.regexp_extract_all(line, F.lit(ATTRIBUTE), F.lit(1))).alias("_attrs"),
    ).where(F.col("_class") | F.col("_attr") | ~F.col("_blank"))
    other = F.when(F.col("_attr"), 0).otherwise(1)
    sliced = bucketed(facts, F.floor(F.col("line_no") / LINES))
    counted = running_sum(sliced, keys, ["line_no"], other, "_run").withColumn("_run", F.col("_run") - other)  # lines of one run share the number of other lines before them
    runs = last_known(counted, keys, ["line_no"], F.col("_ns"), "namespace").where(F.col("_class") | F.col("_attr"))
    wr = Window.partitionBy(*keys, "_run")
    merged = runs.withColumn("attributes", F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("_attrs", F.array().cast("array<string>"))).over(wr)))))
    return merged.where("_class").select(*keys, "line_no", "class_name", "base_class", F.coalesce("namespace", F.lit("")).alias("namespace"), "attributes")


# Words, attributes and methods that describe a target project.
AUTH_INDICATORS = (
    "TestLogin", "BaseUrl", "Login", "SignIn", "Authenticate", "Credentials", "DefaultEnvParams", "TestSettings", "Auth", "Token", "ApiKey", "Password",
)
LOCATOR_ATTRIBUTES = (
    "data-testid", "data-test-id", "data-test", "data-tid", "data-cy", "data-qa", "data-e2e", "aria-label", "aria-labelledby", "role",
)
LOCATOR_METHODS = (
    "GetByTestId", "GetByText", "GetByRole", "GetByLabel", "GetByPlaceholder", "GetByAltText", "GetByTitle", "Locator(", "Click(", "Fill(",
    "FillAsync(", "ClickAsync(", "PressKey", "PressAsync", "Check(", "CheckAsync(", "Uncheck(", "UncheckAsync(", "SelectOption", "Expect(",
    "ToBeVisible", "ToContainText", "Locator", "GetBy",
)
HELPER_PREFIXES: Mapping[str, str] = {
    "Login": "Auth", "GoTo": "Navigation", "Open": "Navigation", "Navigate": "Navigation", "WaitFor": "Wait", "ValidateLoading": "Validation",
    "InputAndSelect": "Interaction", "Select": "Interaction", "ClickAndOpen": "Navigation", "Setup": "Setup", "Init": "Setup",
    "Configure": "Setup", "Assert": "Validation", "Verify": "Validation", "Ensure": "Validation", "Fill": "Interaction", "Type": "Interaction",
    "Choose": "Interaction",
}
# Words in the names of variables that hold a route.
ROUTE_WORDS = ("url", "base", "route")
GOTO_VARIABLE = r"\.Go[Tt]oAsync\s*\(\s*([A-Za-z_][\w.]*)\s*[,)]"
METHOD_NAME = r"(?:public|private|protected|internal)\s+(?:static\s+)?(?:async\s+)?[A-Za-z_][\w<>.]*\s+([A-Z]\w*)\s*\("
GOTO_CALL = r"\.(?:GotoAsync|GoToAsync)\s*\(\s*[\"']([^\"']+)[\"']\s*\)"


def occurrence_facts(files: DataFrame, keys: Sequence[str], kind: str, words: Sequence[str], text_col: str = "text", fold_case: bool = False) -> DataFrame:
    """(kind, name, n) per file for every word that occurs; one pass over the text, one row per hit word."""
    text = F.lower(F.col(text_col)) if fold_case else F.col(text_col)
    counted = F.array(
        *[
            F.struct(
                F.lit(word).alias("name"),
                ((F.length(text) - F.length(F.replace(text, F.lit(word.lower() if fold_case else word), F.lit("")))) / len(word)).cast("bigint").alias("n"),
            )
            for word in words
        ]
    )
    return files.select(*keys, F.explode(F.filter(counted, lambda x: x["n"] > 0)).alias("_c")).select(
        *keys, F.lit(kind).alias("kind"), "_c.name", "_c.n"
    )


def extract_target_facts(files: DataFrame, keys: Sequence[str], text_col: str = "text", attributes: Sequence[str] = LOCATOR_ATTRIBUTES) -> DataFrame:
    """Navigation, authentication, locator attribute, locator method and helper method facts of a target project, one long table.

    A page may be opened by a literal or through a variable whose name speaks of a url, a base or a route; a helper
    is a declared method whose name starts like one.
    """
    listed = lambda pattern: F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1))
    named = lambda kind, names: files.select(*keys, F.lit(kind).alias("kind"), F.explode(names).alias("name")).groupBy(*keys, "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        occurrence_facts(files, keys, "locator-attribute", attributes, text_col, fold_case=True),
        occurrence_facts(files, keys, "locator-method", LOCATOR_METHODS, text_col),
        occurrence_facts(files, keys, "auth-indicator", AUTH_INDICATORS, text_col, fold_case=True).withColumn("n", F.lit(1).cast("bigint")),
        named("navigation", listed(GOTO_CALL)),
        named("navigation-variable", F.filter(listed(GOTO_VARIABLE), lambda v: F.rlike(F.lower(v), F.lit("|".join(ROUTE_WORDS))))),
        named("helper-method", F.filter(listed(METHOD_NAME), lambda m: helper_use(m).isNotNull())),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def helper_use(name: Column | str, prefixes: Mapping[str, str] = HELPER_PREFIXES) -> Column:
    """What a helper method is probably for, by the longest prefix of its name."""
    low = F.lower(as_col(name))
    expr = None
    for prefix in sorted(prefixes, key=lambda p: (-len(p), p)):
        cond = F.startswith(low, F.lit(prefix.lower()))
        expr = F.when(cond, F.lit(prefixes[prefix])) if expr is None else expr.when(cond, F.lit(prefixes[prefix]))
    return expr


