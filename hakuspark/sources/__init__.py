"""Reading and counting text files; Parquet and other tables come from Spark's own readers."""

from hakuspark.sources.text import count_file, count_line, kana_lines, whole_texts, without_lines

__all__ = ["count_file", "count_line", "kana_lines", "whole_texts", "without_lines"]
