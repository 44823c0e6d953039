"""Operators over spans, events, timelines, links, statistics and logs. Each takes and returns DataFrames."""
