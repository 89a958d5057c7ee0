"""Annotation labels as column expressions: parsing, tolerant vocabulary matching, point winner, mirroring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The annotation vocabularies, in the order in which prefixes are tried.
SIDES = ("left", "right")
HANDS = ("forehand", "backhand")
TECHNIQUES = ("serve", "loop", "block", "push", "flick", "lob", "chop", "smash")
LEANS = ("neutral", "back_heavy", "front_heavy", "right_leaning", "left_leaning", "unknown")
FEET = ("both_feet_planted", "left_foot_lifted", "right_foot_lifted", "both_feet_lifted", "unknown")
OUTCOMES = ("net", "not_hitting_ball", "winner", "double_bounce", "out", "miss_on_own_side")
#: Endings with which the player who caused them wins the point.
WON = ("winner", "double_bounce")
#: Labels that change under mirroring.
MIRROR = {"left": "right", "right": "left", "left_leaning": "right_leaning", "right_leaning": "left_leaning", "left_foot_lifted": "right_foot_lifted", "right_foot_lifted": "left_foot_lifted"}


def match_prefix(token: Column, vocabulary: tuple[str, ...]) -> Column:
    """The token itself if it is a word of the vocabulary, else the first word that it begins or that begins with it."""
    words = F.array(*[F.lit(v) for v in vocabulary])
    near = F.filter(words, lambda v: F.startswith(token, v) | F.startswith(v, token))
    return F.when(token.isin(*vocabulary), token).otherwise(F.coalesce(F.try_element_at(near, F.lit(1)), F.lit("unknown")))


def parse_label(raw: Column) -> Column:
    """Struct kind, side, hand, technique, lean, feet, outcome of an annotation; null if it means nothing.

    Bare words come before sides: "net" is a crossing, "left_net" an ending.
    """
    parts = F.split(F.trim(F.regexp_replace(raw, r"\s+", " ")), " ")

    def body(p: Column) -> Column:
        pieces = F.split(F.regexp_replace(F.try_element_at(p, F.lit(1)), "^x+", ""), "_", 2)
        rest = F.coalesce(F.try_element_at(pieces, F.lit(2)), F.lit(""))
        tokens = F.struct(F.array_join(pieces, "_").alias("head"), F.try_element_at(pieces, F.lit(1)).alias("side"), rest.alias("rest"), F.split(rest, "_", 2).alias("stroke"), F.try_element_at(p, F.lit(2)).alias("lean"), F.try_element_at(p, F.lit(3)).alias("feet"))
        return _bind(tokens, _event)

    return _bind(parts, body)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, not at each mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _event(t: Column) -> Column:
    hand, technique = F.try_element_at(t["stroke"], F.lit(1)), F.try_element_at(t["stroke"], F.lit(2))
    is_side = t["side"].isin(*SIDES)
    kind = (
        F.when(t["head"] == "bounce", "bounce").when(t["head"] == "net", "net_cross").when(t["head"] == "empty_event", "empty")
        .when(is_side & t["rest"].isin(*OUTCOMES), "rally_end").when(is_side & hand.isin(*HANDS) & technique.isin(*TECHNIQUES), "stroke")
    )

    def fields(k: Column) -> Column:
        stroke, ending = k == "stroke", k == "rally_end"
        known = lambda token, words: F.when(stroke, F.coalesce(match_prefix(token, words), F.lit("unknown")))
        return F.when(
            k.isNotNull(),
            F.struct(
                k.alias("kind"), F.when(stroke | ending, t["side"]).alias("side"), F.when(stroke, hand).alias("hand"), F.when(stroke, technique).alias("technique"),
                known(t["lean"], LEANS).alias("lean"), known(t["feet"], FEET).alias("feet"), F.when(ending, t["rest"]).alias("outcome"),
            ),
        )

    return _bind(kind, fields)


def other_side(side: Column) -> Column:
    return F.when(side == "right", "left").otherwise("right")


def point_winner(kind: Column, side: Column, outcome: Column) -> Column:
    """The causer of an ending wins with a winner or a double bounce, and loses with all others."""
    return F.when(kind == "rally_end", F.when(outcome.isin(*WON), side).otherwise(other_side(side)))


def mirrored(label: Column) -> Column:
    swap = F.create_map(*[F.lit(x) for kv in MIRROR.items() for x in kv])
    return F.coalesce(F.try_element_at(swap, label), label)
