"""DataFrame operators over the scan log and the signal log."""
