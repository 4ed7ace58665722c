"""Readers, writers and the registration of new series and samples."""
