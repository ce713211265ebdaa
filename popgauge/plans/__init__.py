"""Whole jobs composed from the operators: scoring, reports, task catalog, table builders."""
