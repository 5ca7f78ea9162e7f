"""Folders of the given tables.  Test modules import them from here: the
name ``conftest`` is taken by whichever folder pytest collects last."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
