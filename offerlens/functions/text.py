"""Text expressions: all columns to columns, evaluated in the JVM unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats that results must have.
QUESTION = "What does this cost to the nearest dollar?"
PRICE_PREFIX = "Price is $"
CONTEXT_HEAD = "To provide some context, here are some other items that might be similar to the item you need to estimate.\n\n"
ESTIMATE_HEAD = "Estimate the price of this product. Respond with the price, no explanation\n\n"
SCANNER_HEAD = """Respond with the most promising 5 deals from this list, selecting those which have the most detailed, high quality product description and a clear price that is greater than 0.
    You should rephrase the description to be a summary of the product itself, not the terms of the deal.
    Remember to respond with a short paragraph of text in the product_description field for each of the 5 items that you select.
    Be careful with products that are described as "$XXX off" or "reduced by $XXX" - this isn't the actual price of the product. Only respond with products when you are highly confident about the price. 
    
    Deals:
    
    """
SCANNER_TAIL = "\n\nInclude exactly 5 deals, no more."
FEATURES_MARKER = "Features"
LIMITS = {"title": 100, "details": 500, "features": 500}
ANSI_RESET = "\033[0m"
ANSI_COLORS = {
    "\033[40m\033[31m": "#dd0000",
    "\033[40m\033[32m": "#00dd00",
    "\033[40m\033[33m": "#dddd00",
    "\033[40m\033[34m": "#0000ee",
    "\033[40m\033[35m": "#aa00dd",
    "\033[40m\033[36m": "#00dddd",
    "\033[40m\033[37m": "#87CEEB",
    "\033[44m\033[37m": "#ff7800",
}


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^<]+?>", "")


def before_marker(text: Column, marker: str = FEATURES_MARKER) -> Column:
    return F.substring_index(text, marker, 1)


def behind_marker(text: Column, marker: str = FEATURES_MARKER) -> Column:
    """What follows the first marker, or the empty text."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substr(text, at + F.lit(len(marker)))).otherwise(F.when(text.isNotNull(), ""))


def cut(text: Column, n: int) -> Column:
    """At most n code points."""
    return F.substring(text, 1, n)


def ellipsis(text: Column, n: int = 40) -> Column:
    return F.when(F.length(text) > n, F.concat(cut(text, n), F.lit("..."))).otherwise(text)


def describe(title: Column, details: Column, features: Column, url: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\nDetails: "), strip(details), F.lit("\nFeatures: "), strip(features), F.lit("\nURL: "), url)


def after_prefix(text: Column, prefix: str = PRICE_PREFIX) -> Column:
    """The part between the first and the second prefix; null without a prefix."""
    return F.try_element_at(F.split(text, r"\Q" + prefix + r"\E"), F.lit(2))


def question_prompt(text: Column) -> Column:
    return F.concat(F.lit(QUESTION + "\n\n"), text, F.lit("\n\n" + PRICE_PREFIX))


def training_prompt(text: Column, price: Column) -> Column:
    """With the price rounded half to even."""
    return F.concat(question_prompt(text), F.bround(price, 0).cast("bigint").cast("string"), F.lit(".00"))


def test_prompt(prompt: Column) -> Column:
    return F.concat(F.substring_index(prompt, PRICE_PREFIX, 1), F.lit(PRICE_PREFIX))


def scanner_prompt(descriptions: Column) -> Column:
    """Of an array of described offers."""
    return F.concat(F.lit(SCANNER_HEAD), F.array_join(descriptions, "\n\n"), F.lit(SCANNER_TAIL))


def shown(title: Column) -> Column:
    """How an offer without a price is shown."""
    return F.concat(F.lit("<"), title, F.lit(">"))


def ansi_to_html(text: Column) -> Column:
    for code, color in ANSI_COLORS.items():
        text = F.replace(text, F.lit(code), F.lit(f'<span style="color: {color}">'))
    return F.replace(text, F.lit(ANSI_RESET), F.lit("</span>"))


def agent_log(name: Column, message: Column, color: str = "\033[37m", ground: str = "\033[40m") -> Column:
    return F.concat(F.lit(ground + color + "["), name, F.lit("] "), message, F.lit(ANSI_RESET))


def display_title(name: Column) -> Column:
    """Function names as titles: every run of cased letters, whatever stands before it, begins in upper case."""
    plain = F.replace(F.replace(name, F.lit("__"), F.lit(".")), F.lit("_"), F.lit(" "))
    runs = F.regexp_extract_all(plain, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.replace(F.array_join(F.transform(runs, F.initcap), ""), F.lit("Gpt"), F.lit("GPT"))


def log_html(lines: Column) -> Column:
    """An array of log lines as HTML lines."""
    return F.array_join(lines, "<br>")
