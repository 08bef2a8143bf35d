"""Column expressions: everything here stays inside the JVM."""

from .scalars import (clip, coarse, count_bucket, draw, epoch_seconds, key_digest,
                      parse_date, star_bucket)
from .text import display_name, hash_tokens, name_tokens, norm_name, strip
from .vectors import dot, l2_normalize, relu

__all__ = ["clip", "coarse", "count_bucket", "draw", "epoch_seconds", "key_digest", "parse_date",
           "star_bucket", "display_name", "hash_tokens", "name_tokens", "norm_name", "strip", "dot",
           "l2_normalize", "relu"]
