"""Inputs shared by the tests of this folder."""
SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
