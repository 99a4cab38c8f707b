"""The measures of relatedness and their parts, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DISTANCE_SAMPLE


def link_probability(link_count: Column, occurrence_count: Column) -> Column:
    """Null where a label never occurs."""
    return F.when(occurrence_count > 0, F.least(link_count / occurrence_count, F.lit(1.0)))


def link_similarity(size_a: Column, size_b: Column, common: Column, n: Column) -> Column:
    """1 - the normalized link distance of two neighbour sets among n pages, at least 0; 0 without common links."""
    big, small = F.greatest(size_a, size_b), F.least(size_a, size_b)
    room = F.log(n) - F.log(small)
    distance = F.when((common == 0) | (room <= 0), 1.0).otherwise((F.log(big) - F.log(common)) / room)
    return F.greatest(F.lit(0.0), 1 - distance)


def lowest_similarity(n: int) -> float:
    """The similarity of the farthest pair that still shares a link; others are rescaled from here."""
    return 1 - math.log(max(min(n - 1, DISTANCE_SAMPLE), 1)) / math.log(n) if n > 1 else 0.0


def rescaled(x: Column, lowest: float) -> Column:
    return (x - lowest) / (1 - lowest)


def link_weight(count: Column, most: Column, degree: Column, n: Column) -> Column:
    """How much a link says about its page: augmented frequency times inverse link frequency."""
    return (0.5 + 0.5 * count / most) * F.log(n / degree)


def cosine(dot: Column, square_a: Column, square_b: Column) -> Column:
    return F.when((square_a > 0) & (square_b > 0), dot / F.sqrt(square_a * square_b)).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def category_score(frequency: Column, inputs: Column) -> Column:
    return frequency / inputs * F.log(frequency + 1)


def link_favouring_weight(link_prob: Column, commonness: Column) -> Column:
    return (link_prob + commonness) / 2


def broad_weight(commonness: Column, in_degree: Column) -> Column:
    return commonness * F.log(in_degree + 1)


def topic_weight(link_prob: Column, occurrences: Column) -> Column:
    return link_prob * occurrences
