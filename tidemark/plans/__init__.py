"""End-to-end investigations and the fixture views the queries run on."""
