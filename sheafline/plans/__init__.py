"""Compositions of operators: the profile of a table, and answers to tables of questions."""
