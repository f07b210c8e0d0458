"""Readers and writers of the files and tables the operators work on."""
