"""Canonical JSON and the identities made of it, as columns: sorted keys, no spaces, all but ASCII escaped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that JSON writes by a letter after a backslash; the backslash itself comes first.
SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_string(text: Column) -> Column:
    """``text`` as a JSON string: control characters and code units above 126 are written by their number. Texts without
    such are escaped as a whole, the others character by character; most have nothing to escape."""
    text = F.coalesce(text, F.lit(""))
    short = text
    for character, written in SHORT.items():
        short = F.replace(short, F.lit(character), F.lit(written))

    def by_number(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return F.when((c == "") | ((c >= " ") & (c <= "~")), c).otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))

    odd = F.array_join(F.transform(F.split(short, ""), by_number), "")
    return F.concat(F.lit('"'), F.when(~text.rlike(r'[^\x20-\x7e]|["\\]'), text).when(short.rlike(r"[^\x20-\x7e]"), odd).otherwise(short), F.lit('"'))


def spec_json(name: Column, hypothesis: Column, prediction: Column, falsification: Column, operators: Column) -> Column:
    """A specification; ``operators`` are each canonical JSON already."""
    parts = {"falsification": json_string(falsification), "hypothesis": json_string(hypothesis), "name": json_string(name), "operators": F.concat(F.lit("["), F.array_join(operators, ","), F.lit("]")), "prediction": json_string(prediction)}
    fields = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(parts.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def spec_id(name: Column, hypothesis: Column, prediction: Column, falsification: Column, operators: Column) -> Column:
    """Identity of a whole specification. Null where the operators' texts aren't what :func:`operator_json` writes."""
    return F.when(F.forall(operators, is_operator), F.sha2(spec_json(name, hypothesis, prediction, falsification, operators), 256))


#: A number over 0 and under 1 as it is written shortest: 0.25, 0.0001, 2.5e-05.
_SHARE = r"(?:0\.(?:0{0,3}[1-9])[0-9]*(?<!0)|[1-9](?:\.[0-9]*[1-9])?e-(?:0[5-9]|[1-9][0-9]+))"


def is_operator(text: Column) -> Column:
    """Whether ``text`` is the canonical JSON of an operator with no parameter but a threshold."""
    return text.rlike(r'^\{"name":"[a-z][a-z0-9_]*","params":\{(?:"threshold":' + _SHARE + r")?\}\}$")


def operator_json(name: Column, threshold: Column | None = None) -> Column:
    """Canonical JSON of an operator; ``threshold`` is its number's text, null for none."""
    params = F.lit("") if threshold is None else F.coalesce(F.concat(F.lit('"threshold":'), threshold), F.lit(""))
    return F.concat(F.lit('{"name":"'), name, F.lit('","params":{'), params, F.lit("}}"))
