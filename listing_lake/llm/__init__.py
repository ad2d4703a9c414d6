"""Preparation of training data from the content table and the stored pages."""
