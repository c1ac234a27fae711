"""Deterministic hashing inside BIGINT arithmetic, equal in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (a, b) of the min-hash family (a * x + b) % 49157, in order.
MINHASH_PARAMETERS = [
    (123, 14), (5, 124), (14, 139), (210, 74), (176, 98), (6, 100), (167, 24), (63, 188), (49, 154), (100, 23), (95, 125), (178, 29),
    (31, 130), (148, 41), (3, 197), (176, 76), (11, 122), (4, 134), (16, 157), (204, 79), (178, 91), (8, 101), (168, 25), (43, 158),
    (29, 184), (200, 63), (75, 144), (172, 99), (51, 150), (118, 47), (5, 207), (149, 56), (9, 11), (26, 11), (3, 20),
]
MINHASH_PRIME = 49157

# Fixed values: (a, b) of the distinct-count family (a * x + b) % 12289; consecutive entries are averaged.
DISTINCT_PARAMETERS = [
    (173, 309), (93, 389), (77, 298), (49, 269), (142, 266), (62, 344), (71, 284), (155, 237), (88, 330), (66, 240),
    (83, 236), (26, 322), (132, 367), (98, 349), (28, 300), (110, 314), (183, 319), (185, 388), (2, 315), (164, 268),
    (40, 375), (78, 257), (64, 387), (180, 313), (141, 378), (117, 336), (135, 259), (69, 360), (90, 260), (38, 270),
    (67, 362), (17, 352), (157, 293), (166, 282), (76, 267), (47, 253), (15, 301), (104, 262), (27, 244), (65, 289),
    (186, 331), (95, 248), (151, 356), (138, 343), (24, 334), (14, 397), (58, 206), (102, 335), (74, 364), (195, 366),
]
DISTINCT_PRIME = 12289


def string_mod(c: Column, n: int) -> Column:
    """The big-endian integer of a string's UTF-8 bytes modulo n, by Horner's rule."""
    digits = F.hex(F.encode(c, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    byte = lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint")
    return F.when(F.length(digits) == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, i: (acc * 256 + byte(i)) % n))


def universal(x: Column, a: int, b: int, n: int) -> Column:
    return (F.lit(a).cast("bigint") * x + b) % n


def trailing_zeros(h: Column) -> Column:
    """Zeros at the low end of h in binary; 9 for h = 0."""
    return F.when(h == 0, F.lit(9)).otherwise(F.bit_count(h.bitwiseAND(-h) - 1)).cast("int")
