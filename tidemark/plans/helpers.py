"""What a helper method does, judged from the evidence in its body."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import contains_any, matching_labels
from tidemark.functions.text import first_flag
from tidemark.operators.aggregates import helper_families

# Evidence labels and the texts that show them in a body.
BODY_EVIDENCE: Mapping[str, Sequence[str]] = {
    "selenium-find-element": ("FindElement", "FindElements", "By.CssSelector", "By.XPath", "By.Id", "By.Name"),
    "selenium-webdriver-wait": ("WebDriverWait", "ExpectedConditions", "Until(", ".Until"),
    "selenium-webdriver-types": ("IWebElement", "IWebDriver", "OpenQA.Selenium"),
    "selenium-actions": ("Actions(", "MoveToElement", "DoubleClick", "ContextClick", "DragAndDrop"),
    "keyboard-input": ("SendKeys", "Keys.Enter", "Keys.Return", "Press", "InputText", "InputAndAccept", "ManualInputValue"),
    "mouse-click": (".Click", "ClickAnd", "DoubleClick", "ContextClick"),
    "clear-fill": (".Clear", "ClearAnd", "Fill", "SetValue"),
    "select-change": ("SelectBy", "SelectValue", "SelectText", "SelectOption", ".Select("),
    "navigation": ("OpenPage", "GoToPage", "Navigate", ".GoToUrl", ".Url", "Goto"),
    "project-loader-wait": ("Loader", "ValidateLoading", "WaitLoading", "WaitForLoading"),
    "wait-presence": ("WaitPresence", "WaitVisible", "WaitAbsence", "WaitClickable", "WaitEnabled"),
    "thread-sleep": ("Thread.Sleep", "Task.Delay"),
    "read-only-probe": ("Displayed", "Enabled", "Exists", "Visible", "GetAttribute", ".Text", "GetText", "Count"),
    "assertion": ("Assert.", ".Should(", ".Should().", "BeEquivalentTo", "Contains("),
    "javascript": ("ExecuteScript", "ExecuteAsyncScript"),
}
SAVING_NAMES = ("Save", "Delete", "Remove", "Create", "Add", "Update", "Submit", "Accept")
SIDE_EFFECT_NAMES = (
    "Input", "Accept", "Click", "SendKeys", "Press", "ManualInput", "Select", "Save", "Delete", "Remove", "Create", "Add", "Update", "Submit",
    "OpenPage", "GoToPage", "Navigate", "Clear", "SetValue",
)
WAIT_NAMES = ("Wait", "Loader", "Loading", "Presence", "Visible", "Clickable", "Absence")
SAFE_WAIT_NAMES = ("WaitPresence", "WaitVisible", "WaitAbsence", "WaitClickable", "WaitEnabled", "WaitDisappear")
READ_ONLY_NAMES = ("Exists", "Visible", "Displayed", "Enabled", "GetText", "Text", "Count", "GetAttribute", "IsVisible")
SIDE_EFFECTS = ("keyboard-input", "mouse-click", "clear-fill", "select-change", "navigation", "javascript", "save-delete-action")
WAITS = ("selenium-webdriver-wait", "project-loader-wait", "wait-presence", "thread-sleep")
RISKS = {"RequiredSideEffect": "high", "ProjectWaitHelper": "medium", "SafeWaitElide": "low", "ReadOnlyProbe": "low", "AssertionHelper": "medium"}


def helper_semantics(
    bodies: DataFrame, evidence: Mapping[str, Sequence[str]] = BODY_EVIDENCE, name_col: str = "name", body_col: str = "body", invoked: str | None = None
) -> DataFrame:
    """Evidence, semantics, confidence and risk of each method body; ``invoked`` is an optional array of called names."""
    called: Column = F.array_join(F.col(invoked), "\n") if invoked else F.lit("")
    rules = [(label, contains_any(body_col, words)) for label, words in evidence.items()]
    rules.append(("save-delete-action", contains_any(name_col, SAVING_NAMES)))
    rows = bodies.withColumn("evidence", matching_labels(rules))
    has = lambda labels: F.arrays_overlap("evidence", F.array(*[F.lit(x) for x in labels]))
    calls_side = contains_any(called, SIDE_EFFECT_NAMES)
    side = has(SIDE_EFFECTS) | calls_side | contains_any(name_col, SIDE_EFFECT_NAMES)
    loader = has(["project-loader-wait"])
    wait = has(WAITS) | contains_any(name_col, WAIT_NAMES)
    safe_wait = contains_any(name_col, SAFE_WAIT_NAMES) & ~loader
    asserting = has(["assertion"])
    reading = has(["read-only-probe"]) | contains_any(name_col, READ_ONLY_NAMES)
    selenium = F.exists("evidence", lambda e: F.startswith(e, F.lit("selenium-")))
    semantics = first_flag(
        [
            ("RequiredSideEffect", side), ("SafeWaitElide", wait & safe_wait), ("ProjectWaitHelper", wait),
            ("ReadOnlyProbe", reading & ~asserting), ("AssertionHelper", asserting),
        ],
        "UnknownUnsafe",
    )
    confidence = (
        F.when(side, F.when(selenium | calls_side, 0.88).otherwise(0.74)).when(wait & safe_wait, 0.82)
        .when(wait, F.when(loader, 0.84).otherwise(0.68)).when(reading & ~asserting, 0.76).when(asserting, 0.64).otherwise(0.35)
    )
    risk = F.create_map(*[F.lit(x) for kv in RISKS.items() for x in kv])
    judged = rows.withColumns({"semantics": semantics, "confidence": confidence})
    return judged.withColumn("risk", F.coalesce(F.try_element_at(risk, F.col("semantics")), F.lit("unknown")))


def helper_inventory(bodies: DataFrame, evidence: Mapping[str, Sequence[str]] = BODY_EVIDENCE, name_col: str = "name") -> DataFrame:
    """Families of helper methods over all bodies of all projects."""
    return helper_families(helper_semantics(bodies, evidence, name_col), name_col)
