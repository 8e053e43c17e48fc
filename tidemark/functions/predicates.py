"""Row predicates and per-file signals. Rule lists are plain data with defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import extension, file_name
from tidemark.functions.text import as_col, contains_ci, first_flag


def contains_any(c: Column | str, needles: Sequence[str]) -> Column:
    low = F.lower(as_col(c))
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.contains(low, F.lit(n.lower()))
    return cond


def contains_any_exact(c: Column | str, needles: Sequence[str]) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.contains(as_col(c), F.lit(n))
    return cond


def search_all_tokens(df: DataFrame, cols: Sequence[str], query: str) -> DataFrame:
    """Rows whose concatenated columns contain every blank-separated token, ignoring case."""
    hay = F.lower(F.concat_ws(" ", *[F.col(c) for c in cols]))
    cond = F.lit(True)
    for token in query.lower().split():
        cond = cond & F.contains(hay, F.lit(token))
    return df.where(cond)


def matching_labels(rules: Sequence[tuple[str, Column]]) -> Column:
    """Labels of every rule that holds, in rule order."""
    return F.filter(F.array(*[F.when(cond, F.lit(label)) for label, cond in rules]), lambda x: x.isNotNull())


# Signals of a test source file and their patterns.
FILE_SIGNALS: Mapping[str, str] = {
    "tests": r"\[(?:Test|TestCase|Fact|Theory|TestMethod)\b|@(?:Test|org\.junit\.Test)\b|def\s+test_\w+|unittest\.TestCase",
    "locators": r"\bBy\.|findElement|findElements|find_element|find_elements|FindElement|FindElements",
    "xpaths": r"XPath|xpath|By\.XPath|By\.xpath|By\.XPATH",
    "assertions": r"Assert\.|Should\(\)|assertThat|assert\s+|self\.assert",
    "waits": r"WebDriverWait|ExpectedConditions|Wait|wait\.until|EC\.",
    "helpers": r"Helper|Helpers|Utils|Extensions|BasePage|BaseTest|TestBase|DriverExtensions|ClickAnd|WaitFor|Validate",
    "poms": r'PageObject|PageFactory|IWebElement|WebElement|FindBy|ByTId|data-tid|data-testid|Page\b|page\b',
    "dynamics": r'string\.Format|\$"|\+\s*\w+|ExecuteScript|execute_script|IJavaScriptExecutor|switchTo|SwitchTo|frame|Frame|Alert|alert',
}


def signal_counts(files: DataFrame, signals: Mapping[str, str] = FILE_SIGNALS, text_col: str = "text") -> DataFrame:
    """One count per signal and file. Narrow: each text is read once, no shuffle."""
    cols = {name: F.regexp_count(F.col(text_col), F.lit(p)).cast("bigint") for name, p in signals.items()}
    newlines = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    lines = F.when(F.length(text_col) == 0, 0).otherwise(newlines + 1).cast("bigint")
    return files.withColumns({**cols, "line_count": lines})


# Categories of a test file (pattern, ignore case).
CATEGORY_PATTERNS = (
    ("page-object", r"(?i)class\s+\w+Page\b|PageObject|Pages?\."),
    ("table-filter", r"(?i)Table|Row|Grid|List|Filter|Search"),
    ("assertions", r"(?i)Assert\.|Should\s*\(|CollectionAssert|FluentAssertions"),
    ("waits", r"(?i)WebDriverWait|Wait|Until|Thread\.Sleep"),
    ("custom-helper", None),
    ("xpath-selector", r"(?i)By\.XPath|//|contains\(|following-sibling"),
    ("data-driven", r"(?i)TestCase|TestCaseSource|Theory|InlineData"),
)
SIMPLE_SMOKE = ("simple-smoke", r"FindElement|By\.", 3)
BASE_FIXTURE = ("base-fixture", "base")
CATEGORY_ORDER = (
    "simple-smoke", "page-object", "table-filter", "custom-helper", "waits", "assertions", "xpath-selector", "data-driven", "base-fixture",
)


HELPER_CALL = r"\b([A-Z][A-Za-z0-9_]*)\s*\("
NO_HELPERS = ("assert", "by", "wait", "thread")


def potential_helpers(c: Column | str) -> Column:
    """Distinct called names that start with a capital, ignoring case, without the well-known ones."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(as_col(c), F.lit(HELPER_CALL), F.lit(1)), F.lower))
    return F.size(F.array_except(names, F.array(*[F.lit(n) for n in NO_HELPERS])))


def tag_categories(
    files: DataFrame,
    patterns: Sequence[tuple[str, str | None]] = CATEGORY_PATTERNS,
    simple: tuple[str, str, int] = SIMPLE_SMOKE,
    text_col: str = "text",
    path_col: str = "path",
) -> DataFrame:
    """Array of categories per file; few locators make a simple one, the file name makes a base fixture."""
    label, pattern, most = simple
    rules = [(label, F.regexp_count(F.col(text_col), F.lit(pattern)) <= most)]
    rules += [(name, F.rlike(F.col(text_col), F.lit(p)) if p else potential_helpers(text_col) > 0) for name, p in patterns]
    rules.append((BASE_FIXTURE[0], contains_ci(file_name(path_col), BASE_FIXTURE[1])))
    return files.withColumn("categories", matching_labels(rules))


# Evidence kinds by file name, then by text; first match wins.
KIND_BY_NAME = (
    ("selector-evidence", "selector-evidence"), ("helper-inventory", "helper-inventory"), ("pom-index", "pom-index"),
    ("config-proposals", "config-proposals"), ("runtime-feedback", "runtime-feedback"), ("project-verify", "project-verify"),
    ("verify", "verify"), ("evidence-manifest", "evidence-manifest"), ("report", "migration-report"),
)
KIND_BY_TEXT = (("source-sample", ("By.", "find_element")),)
SIGNALS_BY_TEXT = (
    ("selector-evidence", ("selector-evidence",)), ("helper", ("helper",)),
    ("positive-signal", ("passed", "success")), ("safety-review", ("unsafe", "inferred", "cannot-prove")),
)


def infer_kind(
    files: DataFrame,
    by_name: Sequence[tuple[str, str]] = KIND_BY_NAME,
    by_text: Sequence[tuple[str, Sequence[str]]] = KIND_BY_TEXT,
    signals: Sequence[tuple[str, Sequence[str]]] = SIGNALS_BY_TEXT,
    path_col: str = "path",
    text_col: str = "text",
) -> DataFrame:
    """Evidence kind of a file from its name, else from its text, plus the signals its text carries."""
    name = file_name(path_col)
    cascade = [(kind, contains_ci(name, part)) for part, kind in by_name]
    cascade += [(kind, contains_any(text_col, parts)) for kind, parts in by_text]
    return files.withColumns(
        {
            "kind": first_flag(cascade, "artifact"),
            "signals": matching_labels([(label, contains_any(text_col, parts)) for label, parts in signals]),
        }
    )


# Words of the suppression-safety predicate.
ASSERTION_WORDS = ("assert", "fluentassertions", "nunit")
SUPPRESSION_WORDS = ("suppress", "hide", "skip", "remove")
FORBIDDING_WORDS = (
    "do not", "don't", "never", "cannot", "must not", "forbid", "block", "refuse", "no assertion", "zero assertions suppressed",
)


def unsafe_suppression(
    c: Column | str,
    assertion: Sequence[str] = ASSERTION_WORDS,
    suppression: Sequence[str] = SUPPRESSION_WORDS,
    forbidding: Sequence[str] = FORBIDDING_WORDS,
) -> Column:
    """Speaks of assertions and of suppressing, and forbids neither."""
    return contains_any(c, assertion) & contains_any(c, suppression) & ~contains_any(c, forbidding)


# What a suppression rule must never match.
SUPPRESSION_SECTION = "SuppressedMethodPatterns"
ASSERTION_LIKE = r"(?i)Assert|ClassicAssert|Should\s*\(|FluentAssertions|CollectionAssert"
BROAD_PAGE_LIKE = r"(?i)PageObject|\bPage\b|\*|\.\*"


def dangerous_rule(
    section: Column | str, body: Column | str, assertion_like: str = ASSERTION_LIKE, suppression_section: str = SUPPRESSION_SECTION
) -> Column:
    """Reason why a rule must not be merged, or null."""
    suppressing = F.lower(as_col(section)) == suppression_section.lower()
    return F.when(suppressing & F.rlike(as_col(body), F.lit(assertion_like)), F.lit("assertion-suppression"))


def broad_rule(section: Column | str, body: Column | str, broad: str = BROAD_PAGE_LIKE) -> Column:
    return (F.lower(as_col(section)) == SUPPRESSION_SECTION.lower()) & F.rlike(as_col(body), F.lit(broad))


# Configuration values that leak a private environment.
LEAK_PATTERNS = (
    (r"(?i)DefaultEnvParams\.TestLogin", "internal environment reference"),
    (r"(?i)[A-Z]:\\.*\\Users\\", "local path"),
    (r"(?i)password", "potential password/token"),
    (r"(?i)secret", "potential secret"),
    (r"(?i)token[_\s]?=", "potential token assignment"),
)


def scan_leaks(values: DataFrame, value_col: str, patterns: Sequence[tuple[str, str]] = LEAK_PATTERNS) -> DataFrame:
    """One row per value and pattern that hits. Patterns are an array per row, not a join."""
    found = matching_labels([(label, F.rlike(F.col(value_col), F.lit(p))) for p, label in patterns])
    return values.withColumn("finding", F.explode(found))


# Names and contents that must stay out of a shared bundle.
SENSITIVE_NAME = r"(?i)^\.env(\.|$)|id_rsa|id_dsa|\.pfx$|\.pem$|\.key$"
SENSITIVE_CONTENT = (
    ("credential", r"(?i)\b(?:password|passwd|secret|api[_-]?key|token|client[_-]?secret|connectionstring)\b\s*[:=]"),
    ("bearer", r"(?i)Authorization:\s*Bearer\s+[A-Za-z0-9._~+/-]+=*"),
    ("private-key", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----"),
    ("account-key", r"(?i)AccountKey=|SharedAccessKey="),
    ("cloud-key", r"(?i)aws_access_key_id|aws_secret_access_key"),
)


def screen_sensitive(
    files: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    patterns: Sequence[tuple[str, str]] = SENSITIVE_CONTENT,
    max_bytes: int | None = None,
) -> DataFrame:
    """Adds ``reasons``: all why a file is excluded, none for one that may be shared. Size is one where ``max_bytes`` is given."""
    flags = [("name", F.rlike(file_name(path_col), F.lit(SENSITIVE_NAME))), *([] if max_bytes is None else [("size", F.octet_length(text_col) > max_bytes)])]
    flags += [(label, F.rlike(F.col(text_col), F.lit(p))) for label, p in patterns]
    return files.withColumn("reasons", matching_labels(flags))


def allowed_path(path: Column | str, roots: Sequence[str]) -> Column:
    """Equal to an allowed root or below it, ignoring case; an empty root allows everything."""
    p = F.lower(F.replace(as_col(path), F.lit("\\"), F.lit("/")))
    cond = F.lit(False)
    for root in roots:
        r = root.replace("\\", "/").strip().lower().rstrip("/")
        if not r:
            return F.lit(True)
        cond = cond | (p == r) | F.startswith(p, F.lit(r + "/"))
    return cond


def scope_violations(changes: DataFrame, allowed_roots: Sequence[str], baseline: DataFrame, keys: Sequence[str] = ("path", "sha")) -> DataFrame:
    """Changed files outside the allowed roots that the baseline did not already hold unchanged."""
    return changes.where(~allowed_path(keys[0], allowed_roots)).join(baseline.select(*keys), list(keys), "left_anti")


# Media and trace evidence by extension and path hint; first match wins.
EVIDENCE_RULES = (
    ("trace-archive", (".zip",), ("trace", "playwright")),
    ("screenshot", (".png", ".jpg", ".jpeg", ".webp"), ("screenshot", "test-results")),
    ("video", (".webm", ".mp4"), ("video", "test-results")),
    ("console-network-log", (".har", ".trace", ".network", ".jsonl"), ("network", "console", "trace")),
)


def evidence_kind(path: Column | str, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]] = EVIDENCE_RULES) -> Column:
    """Kind of a binary evidence file from its path alone; null when it is none."""
    ext = extension(path)
    return first_flag([(kind, ext.isin(*exts) & contains_any(path, hints)) for kind, exts, hints in rules])


# Spellings of memory kinds.
KIND_SPELLINGS = {
    "decision": "decision", "warning": "warning", "antipattern": "antipattern", "anti-pattern": "antipattern",
    "lesson": "final-gate-lesson", "final-gate-lesson": "final-gate-lesson", "note": "user-note", "user-note": "user-note",
    "preference": "preference", "constraint": "constraint", "": "user-note",
}


def normalize_kind(c: Column | str, spellings: Mapping[str, str] = KIND_SPELLINGS) -> Column:
    """Canonical kind, ``user-note`` when blank, null when unknown."""
    key = F.lower(F.trim(F.coalesce(as_col(c), F.lit(""))))
    lookup = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    return F.try_element_at(lookup, key)
