from codesieve.functions.text import (byte_len, byte_prefix, before_first, count_literal,
                                     go_rtrim, go_trim, lines_of, replace_first)

__all__ = ["byte_len", "byte_prefix", "before_first", "count_literal", "go_rtrim",
           "go_trim", "lines_of", "replace_first"]
