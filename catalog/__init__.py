"""Every query on the test tables, with SQL that states the expected result."""
