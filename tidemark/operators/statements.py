"""Action facts of source lines: calls are cut out of a statement, and word tables say what a call means.

One line is looked at in four generic ways: which calls it makes, what the arguments of a call are, which
element an expression names, and whether it is an assertion. Nothing here knows a whole statement; the tables
of a ``Dialect`` give the words.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import trim_all
from tidemark.operators.facts import common_kind

# Quoted text as runs between escapes in a possessive loop: the JVM matches it without recursion.
DOUBLE = r'"[^"\\]*(?:\\.[^"\\]*)*+"'
SINGLE = r"'[^'\\]*(?:\\.[^'\\]*)*+'"


def _nested(text: str, depth: int) -> str:
    """Balanced text without an outer bracket, ``depth`` levels deep."""
    inner = rf"(?:{text}|\({_nested(text, depth - 1)}\))" if depth else text
    return rf"""[^()"']*+(?:{inner}[^()"']*+)*+"""


@dataclass(frozen=True)
class Dialect:
    """Words of one source language."""

    literal: str
    finders: Sequence[str]
    actions: Mapping[str, str]
    reads: Mapping[str, str]
    asserts: Sequence[str] = ()
    matchers: Sequence[str] = ()
    conditions: Mapping[str, str] = field(default_factory=dict)
    absent: Sequence[str] = ()
    containing: Sequence[str] = ()
    negations: str = ""
    browsers: Sequence[str] = ()
    visits: Sequence[str] = ()
    self_names: Sequence[str] = ("this",)
    properties: Sequence[str] = ()
    keyword_assert: bool = False
    declares: str = ""
    extra: Sequence[str] = field(default=())


# Names of calls and conditions of the three source languages and the labels of the facts.
JAVA = Dialect(
    literal=DOUBLE, finders=("findElement", "findElements"), actions={"click": "click", "sendKeys": "send-keys", "clear": "clear"}, reads={"getText": "text", "isDisplayed": "displayed"},
    asserts=("assertEquals", "assertNotEquals", "assertTrue", "assertFalse", "assertThat"), matchers=("contains", "is", "equalTo", "containsString", "isEqualTo", "isNotEqualTo", "doesNotContain"),
    containing=("contains", "containsString", "doesNotContain"),
    negations=r"(?<!\w)(?:assertFalse|assertNotEquals|isFalse|isNotEqualTo|doesNotContain|not)\s*\(|(?<=[(,])\s*false\s*(?=[,)])|(?<=[(,&|])\s*!\s*(?=[\w(])",
    conditions={
        "visibilityOf": "visible", "invisibilityOf": "visible", "visibilityOfElementLocated": "visible", "invisibilityOfElementLocated": "visible", "presenceOfElementLocated": "present", "elementToBeClickable": "clickable",
        "stalenessOf": "attached", "textToBePresentInElement": "text", "textToBePresentInElementLocated": "text", "textToBePresentInElementValue": "value",
    },
    absent=("invisibilityOf", "invisibilityOfElementLocated", "stalenessOf", "not"),
    browsers=("driver", "webDriver", "browser"), visits=("get", "to"), declares=r"^\s*(?:WebElement|var)\s+\w+\s*=", extra=("until",),
)
PYTHON = Dialect(
    literal=f"(?:{DOUBLE}|{SINGLE})", finders=("find_element", "find_element_by_id", "find_element_by_name", "find_element_by_class_name", "find_element_by_css_selector", "find_element_by_xpath", "find_element_by_link_text", "find_element_by_partial_link_text"),
    actions={"click": "click", "send_keys": "send-keys", "clear": "clear"}, reads={"is_displayed": "displayed"}, properties=("text",),
    asserts=("assertEqual", "assertNotEqual", "assertTrue", "assertFalse", "assertIn", "assertNotIn"),
    negations=r"(?<!\w)(?:assertFalse|assertNotEqual|assertNotIn)\s*\(|(?<![\w.])(?:not|False)(?!\w)|!=",
    conditions={
        "visibility_of_element_located": "visible", "invisibility_of_element_located": "visible", "presence_of_element_located": "present", "presence_of_all_elements_located": "present", "element_to_be_clickable": "clickable",
        "visibility_of": "visible", "invisibility_of": "visible", "staleness_of": "attached", "text_to_be_present_in_element": "text", "text_to_be_present_in_element_value": "value", "invisibility_of_element": "visible",
    },
    absent=("invisibility_of_element_located", "invisibility_of_element", "invisibility_of", "staleness_of", "until_not"),
    browsers=("driver", "browser", "page_driver"), visits=("get",), self_names=("self", "cls"), keyword_assert=True, declares=r"^\s*[A-Za-z_][\w.]*\s*=(?!=)", extra=("until", "until_not"),
)
CSHARP = Dialect(
    literal=DOUBLE, finders=("FindElement", "FindElements"), actions={"Click": "click", "SendKeys": "send-keys"}, reads={}, extra=("ElementAt", "Should", "OpenPage", "GoToUrl"),
    negations=r"(?<!\w)Assert\s*\.\s*(?:IsFalse|False|AreNot\w+|IsNot\w+|Not\w+|DoesNot\w+)\s*\(|(?<!\w)(?:Is|Does|Has)\s*\.\s*(?:False|Not|No)(?!\w)|\)\s*\.\s*NotBe\w*\s*\(",
)
DIALECTS = {"java": JAVA, "python": PYTHON, "csharp": CSHARP}


def unquoted(text: Column) -> Column:
    """Content of a literal; other text as it is. The text is named once, so that it is cut once."""
    return F.regexp_replace(trim_all(text), r"""^(?:"([^"]*)"|'([^']*)')\z""", "$1$2")


def without_words(line: Column) -> Column:
    """The line with quoted text that has no bracket emptied: every call it makes is still there, as none spans a quote."""
    return F.regexp_replace(line, r""""[^"(]*"|'[^'(]*'""", '""')


def _known(dialect: Dialect) -> str:
    names = {*dialect.finders, *dialect.actions, *dialect.reads, *dialect.asserts, *dialect.matchers, *dialect.conditions, *dialect.extra}
    return rf"(?<![A-Za-z0-9_])({'|'.join(sorted(names, key=lambda n: (-len(n), n)))})\s*(?:<\w+>\s*)?\("


def calls(names: Sequence[str]) -> Column:
    """Whether one of the named calls is among those the line makes."""
    return F.arrays_overlap(F.col("_calls"), F.array(*[F.lit(n) for n in names]))


def arguments(line: Column, names: Sequence[str], literal: str) -> Column:
    """Text between the brackets of the first of the named calls; nested calls and quoted brackets belong to it."""
    return F.regexp_extract(line, rf"(?<![A-Za-z0-9_])(?:{'|'.join(names)})\s*(?:<\w+>\s*)?\(({_nested(literal, 4)})\)", 1)


def split_arguments(args: Column, literal: str) -> Column:
    """The arguments between commas that stand outside brackets and quotes."""
    one = rf"(?:[^(),\"']++|{literal}|\({_nested(literal, 4)}\))++"
    return F.transform(F.regexp_extract_all(args, F.lit(one), F.lit(0)), trim_all)


def receiver(text: Column, members: Sequence[str], self_names: Sequence[str]) -> Column:
    """Name before ``.member`` when it is a plain name of its own, else empty: the tail of a chain is no name."""
    own = "|".join(rf"{n}\." for n in self_names)
    return F.regexp_extract(text, rf"(?:^|[^\w.)\]])((?:{own})?[A-Za-z_]\w*+)\s*\.\s*(?:{'|'.join(members)})(?!\w)", 1)


def located_by(text: Column, d: Dialect, group: int = 0) -> Column:
    """The locator of a line from its factory or finder on: 1 its factory, 2 its finder, 3 the strategy named by text, 4 the text looked for."""
    return F.regexp_extract(text, rf"(?<!\w)(?:By\s*\.\s*(\w+)\s*[(,]|({'|'.join(d.finders)})\s*\((?:\s*({d.literal})\s*,)?)\s*({d.literal})", group)


def element(text: Column, found: Column, d: Dialect) -> Column:
    """``(form, name, by)`` of the element an expression works on: found by a locator's text, by a stored locator, or a variable.

    ``by`` is the common kind of the locator where the line itself names it, else empty.
    """
    finders = "|".join(d.finders)
    part = lambda g: located_by(found, d, g)
    located = part(4)
    kind = F.coalesce(common_kind(part(1)), common_kind(F.regexp_replace(part(2), "^.*_by_", "")), common_kind(F.replace(unquoted(part(3)), F.lit(" "), F.lit(""))), F.lit(""))
    stored = F.regexp_extract(F.col("_short"), rf"(?<!\w)(?:{finders})\s*\(\s*(?:this\.|self\.)?([A-Za-z_]\w*)\s*\)", 1)
    named = receiver(text, [*d.actions, *d.reads, *d.properties], d.self_names)
    by = lambda form, name, kind=F.lit(""): F.struct(F.lit(form).alias("form"), name.alias("name"), kind.alias("by"))
    return F.when(located != "", by("direct", unquoted(located), kind)).when(stored != "", by("stored", stored)).when(named != "", by("variable", named))


def fact(kind: Column | str, target: Column | str = "", value: Column | str = "", confidence: str = "Semantic", negated: Column | bool = False, by: Column | str = "", state: Column | str = "") -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    said = {"kind": kind, "confidence": confidence, "target": target, "value": value, "negated": negated, "locator_kind": by, "state": state}
    return F.struct(*[as_column(x).alias(name) for name, x in said.items()])


def on_element(prefix: Column | str, found: Column, value: Column | str = "", negated: Column | bool = False, state: Column | str = "") -> Column:
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.when(found.isNotNull(), fact(F.concat(prefix, F.lit("-"), found["form"]), found["name"], value, negated=negated, by=found["by"], state=state))


def is_negated(pattern: str) -> Column:
    """Whether an odd number of words outside quotes turn the meaning of the line round: two denials are none."""
    return F.pmod(F.regexp_count(F.col("_bare"), F.lit(pattern)), F.lit(2)) == 1


def assertion(line: Column, d: Dialect, found: Column) -> Column:
    """What is asserted of which element; the expected value is the last argument that reads no element, or a matcher's."""
    members = "|".join([*(rf"{r}\s*\(" for r in d.reads), *(rf"{p}(?!\w)" for p in d.properties)])
    others = F.filter(split_arguments(arguments(line, d.asserts, d.literal), d.literal), lambda a: ~F.rlike(a, F.lit(rf"\.\s*(?:{members})")))
    expected = unquoted(F.coalesce(F.try_element_at(others, F.lit(-1)), F.lit("")))
    inner = rf"(?!\s*(?:{'|'.join([*d.matchers, 'not'])})\s*\()"
    by_matcher = unquoted(F.regexp_extract(line, rf"(?<![A-Za-z0-9_])(?:{'|'.join(d.matchers)})\s*\(({inner}{_nested(d.literal, 4)})\)", 1)) if d.matchers else F.lit("")
    negated = is_negated(d.negations)
    displayed = [r for r, label in d.reads.items() if label == "displayed"]
    texts = [r for r, label in d.reads.items() if label == "text"]
    reads_text = calls(texts) if texts else F.lit(False)
    for p in d.properties:
        reads_text = reads_text | F.rlike(line, F.lit(rf"\.\s*{p}(?!\w|\s*\()"))
    equal, within = [a for a in d.asserts if "Equal" in a], [a for a in d.asserts if a.endswith("In")]
    true, that = [a for a in d.asserts if a.endswith(("True", "False"))], [a for a in d.asserts if a.endswith("That")]
    out = F.when(calls(displayed), on_element("assert-displayed", found, negated=negated)).when(calls(equal) & reads_text, on_element("assert-text", found, expected, negated))
    if within:
        out = out.when(calls(within) & reads_text, on_element("assert-contains", found, expected, negated))
    if that:
        kind = F.when(calls(d.containing), "assert-that-contains").otherwise("assert-that-text")
        out = out.when(calls(true) & reads_text & calls(["contains"]), on_element("assert-contains", found, by_matcher, negated)).when(calls(that) & reads_text, on_element(kind, found, by_matcher, negated))
    return F.when(calls(d.asserts) & found.isNotNull(), out)


def sides(line: Column, d: Dialect) -> Column:
    """``left``, ``sign`` and ``right`` of what the keyword ``assert`` compares, empty without a comparison; null for other lines."""
    compared = rf"""^\s*assert\s+(?:not\s+)?((?:[^"']*?{d.literal})*?[^"']*?)\s*(==|!=|\snot\s+in\s|\sin\s)\s*(.+?)\s*$"""
    parts = F.struct(*[F.regexp_extract(line, compared, i + 1).alias(name) for i, name in enumerate(("left", "sign", "right"))])
    return F.when(F.rlike(line, F.lit(r"^\s*assert\b")), parts)


def keyword_assertion(d: Dialect, found: Column) -> Column:
    """``assert`` as a keyword: one side of the comparison reads the element, the other is expected."""
    left, sign, right = (F.col(f"_sides.{name}") for name in ("left", "sign", "right"))
    kind = F.when(F.contains(sign, F.lit("=")), "assert-text").otherwise("assert-contains")
    negated = is_negated(d.negations)
    reads = lambda c: F.rlike(c, F.lit(r"\.\s*text\s*$"))
    of = lambda value: on_element(kind, found, unquoted(value), negated)
    out = F.when(calls(["is_displayed"]), on_element("assert-displayed", found, negated=negated)).when(reads(left), of(right)).when(reads(right), of(left))
    return F.when(F.col("_sides").isNotNull(), out)


def wait(line: Column, d: Dialect, found: Column) -> Column:
    """A wait for a located element, or for one that is held already: for which state, and whether for its end."""
    given = split_arguments(arguments(line, list(d.conditions), d.literal), d.literal)
    plain = F.regexp_extract(F.coalesce(F.try_element_at(given, F.lit(1)), F.lit("")), r"^\s*(?:this\.|self\.)?([A-Za-z_]\w*)\s*$", 1)
    state = F.lit("")
    for name, label in d.conditions.items():
        state = F.when(calls([name]), label).otherwise(state)
    value = F.when(state.isin("text", "value"), unquoted(F.coalesce(F.try_element_at(given, F.lit(-1)), F.lit("")))).otherwise("")
    negated = is_negated(rf"(?<!\w)(?:{'|'.join(d.absent)})\s*\(")
    of = F.when(found["form"].isin("direct", "stored"), on_element("wait", found, value, negated, state)).when(plain != "", fact("wait-element", plain, value, negated=negated, state=state))
    return F.when(calls(["until", "until_not"]) & calls(d.conditions), of)


def action(line: Column, d: Dialect, found: Column) -> Column:
    """A call on an element. A variable's call is the whole statement, so the tail of a longer chain is none."""
    own = "|".join(d.self_names)
    whole = F.rlike(line, F.lit(rf"^\s*(?:(?:{own})\.)?[A-Za-z_]\w*\s*\.\s*(?:{'|'.join(d.actions)})\s*\(.*\)\s*;?\s*$"))
    label = F.lit(None).cast("string")
    for member, name in d.actions.items():
        label = F.when(calls([member]), name).otherwise(label)
    value = unquoted(arguments(line, list(d.actions), d.literal))
    return F.when(label.isNotNull() & found.isNotNull(), F.when((found["form"] != "variable") | whole, on_element(label, found, value)))


def browser_facts(line: Column, d: Dialect, found: Column) -> Column:
    """Facts of test code that drives a browser, in order of how much of the statement they explain."""
    visit = rf"(?<!\w)(?:{'|'.join(d.browsers)})\s*\.\s*(?:navigate\s*\(\s*\)\s*\.\s*)?(?:{'|'.join(d.visits)})\s*\(\s*({_nested(d.literal, 2)})\)"
    visiting = rf"(?<!\w)(?:{'|'.join(d.browsers)})\s*\.\s*(?:navigate\s*\(\s*\)\s*\.\s*)?(?:{'|'.join(d.visits)})\s*\("
    short = F.col("_short")
    visited = F.when(F.rlike(short, F.lit(visiting)), F.regexp_extract(line, visit, 1)).otherwise("")
    page = F.regexp_extract(short, r"=\s*new\s+([A-Z]\w*Page(?:Object)?)\s*\(", 1)
    held = lambda g: F.regexp_extract(line, r"^\s*(?:(?:private|protected|public|static|final|transient|volatile)\s+)*+([A-Z]\w*Page(?:Object)?)\s+([A-Za-z_]\w*)\s*;", g)
    field_kind = F.regexp_replace(F.regexp_extract(line, r"@FindBy\s*\(\s*(?:how\s*=\s*How\s*\.\s*)?(\w+)", 1), "(?i)^css$", "cssSelector")
    caller = F.regexp_extract(line, r"^\s*([A-Za-z_]\w*)\s*\.\s*[A-Za-z_]\w*\s*\([^;]*\)\s*;\s*$", 1)
    steps = [
        F.when(F.contains(line, F.lit("@FindBy")), fact("locator-field", F.regexp_extract(line, r"@FindBy\s*\(\s*([^)]*)\)", 1), by=F.coalesce(common_kind(field_kind), F.lit("")))),
        F.when(F.contains(line, F.lit("By")) & F.rlike(line, F.lit(r"(?<!\w)By\s+\w+\s*=\s*By\s*\.")), fact("locator-declaration", found["name"], by=found["by"])),
        F.when(visited != "", fact("navigation", unquoted(visited))),
        F.when(F.contains(line, F.lit("WebDriverWait")) & F.rlike(short, F.lit(r"=\s*(?:new\s+)?WebDriverWait\s*\(")) & ~calls(["until"]), fact("wait-declaration")),
        wait(line, d, found), assertion(line, d, found), *([keyword_assertion(d, found)] if d.keyword_assert else []), action(line, d, found),
        F.when(calls(d.finders) & F.rlike(line, F.lit(d.declares)), F.when(found.isNotNull(), fact("element-declaration", found["name"], by=found["by"]))),
        F.when(F.rlike(short, F.lit(r"PageFactory\s*\.\s*initElements\s*\(")), fact("page-init")),
        F.when(page != "", fact("page-object", page)),
        F.when(held(1) != "", fact("page-field", held(1), held(2))),
        F.when(F.rlike(short, F.lit(r"\bsuper\s*\(\s*\)\s*\.\s*setUp\s*\(")), fact("setup-super")),
        F.when((caller != "") & ~caller.isin(*d.browsers) & ~calls(d.finders), fact("page-call", caller, confidence="SyntaxFallback")),
    ]
    return F.coalesce(*steps)


def page_facts(line: Column, d: Dialect, found: Column) -> Column:
    """Facts of C# tests: tables of page objects, paging, navigation and element lookups."""
    chain = F.regexp_replace(line, r"\s*\.\s*", ".")
    arg = lambda *names: trim_all(arguments(line, names, d.literal))
    built = F.regexp_extract(arguments(line, d.finders, d.literal), r"\(\s*([^\")][^)]*)\)\s*$", 1)
    located = calls(d.finders) & (found["form"] == "direct")
    steps = [
        F.when(calls(["ElementAt"]) & F.contains(chain, F.lit(".Items.ElementAt(")), F.when(F.contains(chain, F.lit(").Text.Get(")), fact("table-row-text", arg("ElementAt"))).otherwise(fact("table-row", arg("ElementAt")))),
        F.when(calls(["Should"]) & F.contains(chain, F.lit(".Items.Count.Get(")), fact("table-count", F.regexp_extract(chain, r"\.Should\(\s*\)\.((?:Not)?Be\w*)\(", 1), trim_all(F.regexp_extract(chain, r"\.Should\(\s*\)\.(?:Not)?Be\w*\(([^)]+)\)", 1)), negated=is_negated(d.negations))),
        F.when(F.contains(line, F.lit("Pagination")) & F.contains(chain, F.lit("page.Pagination.Forward")), fact("pagination-forward")),
        F.when(calls(["OpenPage"]) & F.contains(chain, F.lit("Navigation.OpenPage")), fact("open-page", unquoted(arg("OpenPage")))),
        F.when(calls(["GoToUrl"]), fact("navigation", unquoted(arg("GoToUrl")))),
        *[F.when(located & calls([m]), fact(label, found["name"], unquoted(arg(m)), by=found["by"])) for m, label in d.actions.items()],
        F.when(located, fact("find-element", found["name"], by=found["by"])),
        F.when(calls(d.finders), F.when(built != "", fact("find-element-dynamic", built, confidence="SyntaxFallback", by=F.coalesce(common_kind(F.regexp_extract(line, r"(?<!\w)By\s*\.\s*(\w+)", 1)), F.lit(""))))),
        F.when(F.contains(line, F.lit("Assert")) & F.rlike(chain, F.lit(r"(?<!\w)Assert\.\w+\(")), fact("assertion", F.regexp_extract(chain, r"(?<!\w)Assert\.(\w+)\(", 1), negated=is_negated(d.negations))),
    ]
    return F.coalesce(*steps)


def joined_statements(lines: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """``keys``, ``line_no``, ``line``: statements of whole files, a chained call that goes on below joined to its first line."""
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), r"\r\n?", "\n"), r"\n\s*(?=\.\s*[A-Za-z_])", "\u0001")
    numbered = lines.select(*keys, F.posexplode(F.split(text, "\n")).alias("_k", "line"), text.alias("_text"))
    before = F.aggregate(F.slice(F.split("_text", "\n"), 1, F.col("_k")), F.lit(0), lambda a, x: a + F.length(x) - F.length(F.replace(x, F.lit("\u0001"), F.lit(""))))
    return numbered.select(*keys, (F.col("_k") + 1 + before).cast("int").alias("line_no"), F.replace(F.col("line"), F.lit("\u0001"), F.lit("")).alias("line"))


def extract_actions(lines: DataFrame, language: str, line_col: str = "line") -> DataFrame:
    """Action facts: kind, confidence, target, value, polarity, locator kind and state of each line that has one. Narrow, JVM only.

    The known calls and the element of a line are cut out once; what they mean is looked up in the tables. Calls are looked for
    where no long quoted text is in the way (``without_words``).
    ``negated`` tells an assertion or wait from its denial (hidden from shown, unequal from equal, ``until_not`` from
    ``until``), ``locator_kind`` is the common kind of a locator named in the line, ``state`` what a wait waits for.
    """
    d, line = DIALECTS[language], F.col(line_col)
    hint = F.contains(line, F.lit("("))
    hint = hint | F.contains(line, F.lit("assert ")) if d.keyword_assert else hint | F.contains(line, F.lit("Pagination")) if language == "csharp" else hint | F.contains(line, F.lit("Page"))
    # Lines without a hint keep nulls instead of being filtered: a filter would be pushed below the making of the line and make it twice.
    told = lambda c: F.when(F.col("_short").isNotNull(), c)
    cut = lines.withColumn("_short", F.when(hint, without_words(line)))
    cut = cut.withColumns({"_calls": F.regexp_extract_all("_short", F.lit(_known(d)), F.lit(1)), "_located": told(located_by(line, d)), "_bare": told(F.regexp_replace(line, d.literal, '""'))})
    if d.keyword_assert:
        cut = cut.withColumn("_sides", told(sides(line, d)))
    cut = cut.withColumn("_element", told(element(line, F.col("_located"), d)))
    facts = page_facts if language == "csharp" else browser_facts
    found = cut.withColumn("_fact", F.explode(told(F.filter(F.array(facts(line, d, F.col("_element"))), lambda f: f.isNotNull()))))
    return found.select(*lines.columns, "_fact.*")
