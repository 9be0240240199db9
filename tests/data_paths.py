"""Where the test data lies."""

SMALL = "/root/testdata/sf0.001"
