"""Whole-pipeline plans built from the operators."""
