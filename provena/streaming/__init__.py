"""Lists that arrive over time, through the plan that searches whole lists."""
