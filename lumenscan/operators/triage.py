"""Triage of findings and proof-of-concept texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import basename


def triage(snippet: Column, variable: Column) -> Column:
    """Struct of is_false_positive, confidence, reasoning for a secret's finding."""
    code, name = F.lower(snippet), F.lower(variable)
    listing = (name == "key") & (code.contains("react") | code.contains("map(") | code.contains("classname"))
    header = (name.contains("api") | name.contains("secret")) & code.contains("header")

    def verdict(wrong: bool, sure: float, why: str) -> Column:
        return F.struct(F.lit(wrong).alias("is_false_positive"), F.lit(sure).alias("confidence"), F.lit(why).alias("reasoning"))

    return (F.when(listing, verdict(True, 0.95, "a list key or style name, not a credential"))
            .when(header, verdict(False, 0.99, "a named credential sent in a header"))
            .otherwise(verdict(False, 0.5, "too little context, needs review")))


# Description and text by type of sink; %v is the variable. Texts only show that a finding is real.
PROOFS = {
    "XSS": ("Script injection through a page or evaluated text", "?%v=<script>alert(1)</script>"),
    "COMMAND_INJECTION": ("Command injection through a process call", '{"%v": "; id #"}'),
    "SQL_INJECTION": ("SQL injection through an unparameterised query", "' OR 1=1 --"),
    "PROTOTYPE_POLLUTION": ("Prototype pollution through merged objects", '{"__proto__": {"polluted": true}}'),
}


def proof(sink_type: Column, path: Column, line: Column, variable: Column) -> Column:
    """Struct of sink_type, description, text."""
    where = F.format_string("Inspect the flow to '%s' in %s at line %d", variable, basename(path), line)
    description, text = F.lit("Data reaches a sink"), where
    for kind, (what, body) in PROOFS.items():
        description = F.when(sink_type == kind, what).otherwise(description)
        text = F.when(sink_type == kind, F.replace(F.lit(body), F.lit("%v"), variable)).otherwise(text)
    return F.struct(sink_type.alias("sink_type"), description.alias("description"), text.alias("text"))
