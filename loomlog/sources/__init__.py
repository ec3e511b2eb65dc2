"""Readers and parsers: files, logger lines, syslog and landed webhook deliveries."""
