"""Action and selector facts of single statements, labelled by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.facts import extract_selectors
from tidemark.operators.statements import extract_actions, joined_statements

JAVA = {
    'driver.findElement(By.id("a(b)")).click();': ("click-direct", "a(b)", ""), "this.box.click();": ("click-variable", "this.box", ""), "a.b.click();": None,
    'String x = menu.click();': None, 'assertEquals("message", "want", name.getText());': ("assert-text-variable", "name", "want"), 'assertEquals(driver.findElement(By.name("n")).getText(), "want, too");': ("assert-text-direct", "n", "want, too"),
    'assertThat(driver.findElement(FIELD).getText(), is("v"));': ("assert-that-text-stored", "FIELD", "v"), 'assertFalse(row.isDisplayed());': ("assert-displayed-variable", "row", ""),
    'wait.until(ExpectedConditions.visibilityOf(driver.findElement(By.id("late"))));': ("wait-direct", "late", ""), "wait.until(ExpectedConditions.elementToBeClickable(button));": ("wait-element", "button", ""),
    'driver.navigate().to("http://h/");': ("navigation", "http://h/", ""), "WebDriverWait wait = new WebDriverWait(driver, 5);": ("wait-declaration", "", ""), "field.sendKeys(name, Keys.ENTER);": ("send-keys-variable", "field", "name, Keys.ENTER"),
    '@FindBy(id = "x")': ("locator-field", 'id = "x"', ""), 'By next = By.xpath("//a");': ("locator-declaration", "//a", ""), "PageFactory.initElements(driver, this);": ("page-init", "", ""), "page.openAll(3);": ("page-call", "page", ""), "return a (b) c": None,
    'driver.findElement(By.id("a")).submit();': None, "driver.quit();": None, "private final LoginPage login;": ("page-field", "LoginPage", "login"), "login = new LoginPage(driver);": ("page-object", "LoginPage", ""), "return LoginPage;": None,
}
PYTHON = {
    'assert driver.find_element(By.ID, "w").text == "a in b"': ("assert-text-direct", "w", "a in b"), 'assert "a in b" not in self.box.text': ("assert-contains-variable", "self.box", "a in b"), "self.assertEqual(box.text, 'x')": ("assert-text-variable", "box", "x"),
    "self.assertIn('x', box.text)": ("assert-contains-variable", "box", "x"), "assert not box.is_displayed()": ("assert-displayed-variable", "box", ""), "self.assertTrue(driver.find_element_by_id('q').is_displayed())": ("assert-displayed-direct", "q", ""),
    "wait.until(EC.staleness_of(driver.find_element(By.ID, 'old')))": ("wait-direct", "old", ""), "self.box.send_keys('t')": ("send-keys-variable", "self.box", "t"), "a.b.c.click()": None, "wait = WebDriverWait(driver, 5)": ("wait-declaration", "", ""),
}
CSHARP = {'Driver.FindElement(By.Id("x")).Click();': ("click", "x", ""), "page.Rows.Items.ElementAt(2).Text.Get();": ("table-row-text", "2", ""), "Assert.That(x);": ("assertion", "That", ""), "Driver.FindElement(By.Id(a + b));": ("find-element-dynamic", "a + b", "")}


# Whether a line denies, the kind of its locator, what it waits for.
TOLD = {
    "java": {
        'assertTrue(driver.findElement(By.id("a")).isDisplayed());': (False, "Id", ""), 'assertFalse(driver.findElement(By.xpath("a")).isDisplayed());': (True, "XPath", ""), "assertTrue(!a.isDisplayed());": (True, "", ""),
        "assertFalse(!a.isDisplayed());": (False, "", ""), "assertThat(a.isDisplayed()).isTrue();": (False, "", ""), "assertThat(a.isDisplayed()).isFalse();": (True, "", ""), "assertThat(a.isDisplayed(), is(false));": (True, "", ""),
        "assertEquals(false, a.isDisplayed());": (True, "", ""), 'assertEquals("false, not(x) !", a.getText());': (False, "", ""), 'assertNotEquals("v", a.getText());': (True, "", ""), 'assertFalse(a.getText().contains("v"));': (True, "", ""),
        'assertThat(a.getText()).isEqualTo("v");': (False, "", ""), 'assertThat(a.getText()).isNotEqualTo("v");': (True, "", ""), 'assertThat(a.getText(), not(containsString("v")));': (True, "", ""),
        'wait.until(ExpectedConditions.visibilityOfElementLocated(By.name("a")));': (False, "Name", "visible"), 'wait.until(ExpectedConditions.invisibilityOfElementLocated(By.name("a")));': (True, "Name", "visible"),
        'wait.until(ExpectedConditions.not(ExpectedConditions.presenceOfElementLocated(By.className("a"))));': (True, "ClassName", "present"), "wait.until(ExpectedConditions.stalenessOf(row));": (True, "", "attached"),
        '@FindBy(css = "li")': (False, "CssSelector", ""), '@FindBy(how = How.LINK_TEXT, using = "x")': (False, "LinkText", ""), 'By next = By.partialLinkText("more");': (False, "PartialLinkText", ""),
    },
    "python": {
        'assert driver.find_element(By.ID, "w").text == "x"': (False, "Id", ""), 'assert driver.find_element(By.TAG_NAME, "w").text != "x"': (True, "TagName", ""), "assert 'not in' in box.text": (False, "", ""), "assert 'x' not in box.text": (True, "", ""),
        "assert box.is_displayed(), 'not shown'": (False, "", ""), "assert not box.is_displayed()": (True, "", ""), "assert box.is_displayed() is False": (True, "", ""), "self.assertFalse(box.is_displayed())": (True, "", ""),
        "self.assertIn('x', box.text)": (False, "", ""), "self.assertNotIn('x', box.text)": (True, "", ""), "self.assertNotEqual(box.text, 'x')": (True, "", ""), 'driver.find_element("css selector", "x").click()': (False, "CssSelector", ""),
        "driver.find_element_by_partial_link_text('q').click()": (False, "PartialLinkText", ""), "w.until(EC.presence_of_element_located((By.ID, 'q')))": (False, "Id", "present"), "w.until_not(EC.presence_of_element_located((By.ID, 'q')))": (True, "Id", "present"),
        "w.until_not(EC.invisibility_of_element_located((By.ID, 'q')))": (False, "Id", "visible"), "w.until(EC.text_to_be_present_in_element_value((By.ID, 'q'), 'v'))": (False, "Id", "value"), "w.until(EC.element_to_be_clickable(self.go))": (False, "", "clickable"),
    },
    "csharp": {
        'Driver.FindElement(By.ClassName("x")).Click();': (False, "ClassName", ""), "Driver.FindElement(By.XPath(a + b));": (False, "XPath", ""), "Assert.IsTrue(x);": (False, "", ""), "Assert.IsFalse(x);": (True, "", ""), "Assert.That(x, Is.Not.Null);": (True, "", ""),
        "Assert.AreNotEqual(a, b);": (True, "", ""), "page.Rows.Items.Count.Get().Should().NotBe(2);": (True, "", ""), "page.Rows.Items.Count.Get().Should().Be(2);": (False, "", ""),
    },
}


@pytest.mark.parametrize("language", sorted(TOLD))
def test_polarity_and_locator_kind(spark, language):
    lines = spark.createDataFrame([(line,) for line in TOLD[language]], "line string")
    assert {r.line: (r.negated, r.locator_kind, r.state) for r in extract_actions(lines, language).collect()} == TOLD[language]


def test_expected_text_of_waits_and_matchers(spark):
    said = {
        'wait.until(ExpectedConditions.textToBePresentInElement(title, "Hello, (you)"));': ("wait-element", "title", "Hello, (you)"), 'assertThat(a.getText(), is(not(equalTo("v"))));': ("assert-that-text-variable", "a", "v"),
        'assertThat(a.getText(), not(containsString("v")));': ("assert-that-contains-variable", "a", "v"), 'assertThat(a.getText()).contains("v");': ("assert-that-contains-variable", "a", "v"),
    }
    lines = spark.createDataFrame([(line,) for line in said], "line string")
    assert {r.line: (r.kind, r.target, r.value) for r in extract_actions(lines, "java").collect()} == said


@pytest.mark.parametrize("language, said", [("java", JAVA), ("python", PYTHON), ("csharp", CSHARP)])
def test_statements(spark, language, said):
    lines = spark.createDataFrame([(line,) for line in said], "line string")
    got = {r.line: (r.kind, r.target, r.value) for r in extract_actions(lines, language).collect()}
    assert got == {line: fact for line, fact in said.items() if fact}


def test_statements_over_several_lines(spark):
    text = 'x();\r\ndriver\n   .findElement(By.id("a"))\n\t.click();\ny();\nmenu\n  .clear();'
    lines = joined_statements(spark.createDataFrame([("f", text)], "path string, text string"), ["path"])
    assert [(r.line_no, r.kind, r.target) for r in extract_actions(lines, "java").orderBy("line_no").collect()] == [(2, "click-direct", "a"), (6, "clear-variable", "menu")]


def test_selectors(spark):
    said = {
        'var a = By.Id("x");': ("Id", "x", "a"), 'self.b = (By.CSS_SELECTOR, "li\\"q")': ("CssSelector", 'li"q', "self.b"), 'p.q.r => ByTestId("t")': ("TestId", "t", "q.r"), 'go(By.xpath("//a"))': ("XPath", "//a", "selector:XPath://a"), 'By.Other("x")': None, 'Bypass("x")': None,
    }
    got = {r.line: (r.kind, r.value, r.source_expr) for r in extract_selectors(spark.createDataFrame([(x,) for x in said], "line string")).withColumn("x", F.lit(1)).collect()}
    assert got == {line: fact for line, fact in said.items() if fact}


def test_selectors_are_all_that_a_call_is_given(spark):
    said = {
        'var item = Driver.FindElement(By.Id("token = "abc" and so on"));': None, 'var a = By.Id("x" + tail);': None, 'var a = By.Id ( "x" );': ("Id", "x", "a"),
        'a = By.Id("x = "y"); b = By.Id("z")': ("Id", "z", "b"), 'go((By.ID, "a"), 5)': ("Id", "a", "selector:Id:a"),
    }
    got = {r.line: (r.kind, r.value, r.source_expr) for r in extract_selectors(spark.createDataFrame([(x,) for x in said], "line string")).collect()}
    assert got == {line: fact for line, fact in said.items() if fact}


def test_a_line_is_made_once(spark):
    """The hint does not make a computed line again below (F12), and brackets inside quotes still hide and show calls as before."""
    rows = ['x = driver.find_element(By.ID, "a (b) c"); y = "d"', "assert 'it (is)' in box.text", 'assert box.text == "p"', "assert box.text", "see \"a\" + box.clear('x') + \"b\"", "don't", "box.click() # isn't \"so (", None]
    made = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string").select("i", F.regexp_replace("raw", "MARKED", "").alias("line"))
    out = extract_actions(made, "python")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MARKED") == 1
    assert {r["i"]: (r["kind"], r["target"], r["value"]) for r in out.collect()} == {
        0: ("element-declaration", "a (b) c", ""), 1: ("assert-contains-variable", "box", "it (is)"), 2: ("assert-text-variable", "box", "p"),
    }
