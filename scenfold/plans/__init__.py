"""The named analyses. Each returns a long frame; ``wide`` pivots as the last step."""
